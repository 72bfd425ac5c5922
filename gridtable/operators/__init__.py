"""Operators over the rows of a table and over results."""
