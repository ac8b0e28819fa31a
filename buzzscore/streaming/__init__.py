"""Structured Streaming version of the cleaning and scoring plan."""
