"""driftline: Spark-native latent-variable time-series analytics."""

__version__ = "0.1.0"
