"""Compositions of operators that users call."""
