"""Versioned population datasets on Spark: packages, set algebra, mutation, pruning, similarity and policy."""
