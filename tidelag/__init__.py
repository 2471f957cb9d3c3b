"""Leak-free lagged features, rankings and evaluations as Spark DataFrame jobs."""
