"""Geodesic question-and-answer analytics on Spark."""
