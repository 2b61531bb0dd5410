"""Compositions of operators: encoding, planning, declarative reshaping, validation, the whole pipeline."""
