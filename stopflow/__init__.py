"""Transit occupancy and snapshot-graph analytics as composable Spark DataFrame operators."""
