"""graphloom: a Spark-native engine for code-graph and document-graph data."""

__version__ = "0.1.0"
