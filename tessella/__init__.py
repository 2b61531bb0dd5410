"""Messy sheets and tables on Spark: cell relations, structure, profiles and tidy plans."""
