"""Readers and writers of post tables."""
