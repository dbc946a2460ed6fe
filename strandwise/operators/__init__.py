"""Relational and kernel operators over reads, k-mers and histograms."""
