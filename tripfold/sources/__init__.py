"""Readers and writers of the run's tables."""
