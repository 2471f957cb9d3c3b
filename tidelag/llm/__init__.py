"""Operators for preparing training text at scale, each a Spark job over whole tables."""
