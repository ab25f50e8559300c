"""Append logs and Structured Streaming."""
