"""Millrace: declarative, resumable Spark pipelines with chunk identity, and map-reduce analytics."""
