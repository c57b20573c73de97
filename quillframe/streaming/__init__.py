"""Streaming of quillframe."""
