"""granary: a PySpark-native engine that curates and audits conversational training data."""

__version__ = "0.1.0"
