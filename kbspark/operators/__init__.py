"""Joins, aggregates, windows and rankings over the knowledge-base tables."""
