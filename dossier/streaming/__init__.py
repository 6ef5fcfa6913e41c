"""Structured Streaming forms of request intake and report text."""
