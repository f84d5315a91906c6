"""Transcript question/answer and rating analytics as PySpark jobs."""
