"""Advertising-inventory analytics and training-data preparation as Spark jobs."""
