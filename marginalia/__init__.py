"""marginalia: a PySpark-native engine for document analytics and grounded question answering."""

__version__ = "0.1.0"
