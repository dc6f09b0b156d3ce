"""lumenfold: Spark-native analytics for fidelity-gated session memory."""

__version__ = "0.1.0"
