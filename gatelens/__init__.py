"""Spark-native policy, provenance and audit analytics over logs of agent tool calls."""

__version__ = "0.1.0"
