"""Column expressions and Arrow-batched functions on cells and ranges."""
