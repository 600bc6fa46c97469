"""Burst analytics for event and state logs, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
