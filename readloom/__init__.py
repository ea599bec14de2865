"""readloom: Spark-native analytics over per-read, position-resolved sequence data."""
