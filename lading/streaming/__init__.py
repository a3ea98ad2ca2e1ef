"""Structured Streaming: the event operators over growing logs."""
