"""Whole queries, assembled from operators."""
