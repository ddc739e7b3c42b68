"""tidelode: a Spark-native engine for preference-data analytics over scientific text files."""

__version__ = "0.1.0"
