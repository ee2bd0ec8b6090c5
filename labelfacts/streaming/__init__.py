"""Structured Streaming over annotation files."""
