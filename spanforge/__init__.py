"""Spark-first diagnostics for question-answering data and training corpora."""
