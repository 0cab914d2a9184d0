"""Batch operators on event tables."""
