"""End-to-end plans: visit enrichment, snapshot graphs, evaluation."""
