"""Readers, writers, staging and the retail view of the test tables."""
