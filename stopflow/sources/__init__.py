"""Readers with declared schemas and partitioned writers."""
