"""Agent-activity analytics on Spark: ingest, validate, detect, correlate, redact, publish."""

__version__ = "0.1.0"
