"""tidefold: Spark-native analytics over append-only job ledgers."""

__version__ = "0.1.0"
