"""tessitura: a Spark-native engine for evaluating and preparing speech transcripts."""

__version__ = "0.1.0"
