"""Scans and storage: markdown corpora, collection snapshots, the embedding cache."""
