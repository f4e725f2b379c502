"""Tables of a corpus of volumes, read from files or derived from the given tables."""
