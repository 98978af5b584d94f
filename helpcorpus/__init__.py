"""Spark-first analytics over large collections of help documents and text corpora."""
