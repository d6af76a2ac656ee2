"""Entity-by-quarter panel analytics as Spark DataFrame operators."""
