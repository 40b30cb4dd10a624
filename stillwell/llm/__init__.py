"""Operators for training corpora: deduplication, packing, filtering, tokens, archives, search and scoring."""
