"""Batch jobs on Spark that build and query section-aware document corpora."""
