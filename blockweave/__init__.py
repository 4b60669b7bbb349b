"""Spark-native block-level near-duplicate analytics: features, votes, delta instructions, packages, statistics."""
