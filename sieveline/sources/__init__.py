"""Readers of bibliographic records and writers of results."""
