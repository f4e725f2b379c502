"""Column expressions that the corpus jobs share."""
