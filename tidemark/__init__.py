"""Spark-first analytics for equity research tables and, in the subpackage ``llm``, for training corpora."""
