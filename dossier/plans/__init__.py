"""Compositions of the stages, and the query catalogue."""
