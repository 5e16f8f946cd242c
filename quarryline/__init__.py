"""Spark-first document analytics: cleaning, layout, tagging, matching, scoring and review."""
