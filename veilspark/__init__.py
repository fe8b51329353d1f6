"""veilspark: rule-driven discovery and removal of sensitive text on Apache Spark."""

__version__ = "0.1.0"
