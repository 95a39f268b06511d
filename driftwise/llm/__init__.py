"""Operators for preparing training text, each a set of Spark jobs over ``documents``."""
