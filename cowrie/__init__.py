"""cowrie: a Spark-native engine for curating, annotating and evaluating question-answer corpora."""

__version__ = "0.1.0"
