"""Predicates, column groups and the query builder."""
