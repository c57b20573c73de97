"""Operators of quillframe."""
