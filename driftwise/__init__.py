"""Explain why business metrics move, as set-based Spark jobs."""
