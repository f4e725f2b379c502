"""Corpus jobs: each works on the tables of all volumes at once, keyed by ``tag``."""
