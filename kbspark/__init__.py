"""Batch and streaming jobs that build, check and query a citable knowledge base with Spark."""
