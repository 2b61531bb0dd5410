"""Operators on the cell relation, on columns and on tables."""
