"""Spark jobs that look for unusual billing in large claims tables."""
