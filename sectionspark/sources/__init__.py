"""Readers and writers: page lines, chunk tables, the vector index, reports."""
