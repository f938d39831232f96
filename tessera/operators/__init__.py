"""Relational building blocks: index build, list traversal, retrieval, evaluation, skew-safe aggregation."""
