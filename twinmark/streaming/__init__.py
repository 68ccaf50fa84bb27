"""Structured Streaming over pair rows."""
