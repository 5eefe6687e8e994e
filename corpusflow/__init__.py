"""Corpusflow: corpus, ranking, graph and log analytics as PySpark DataFrame operators."""
