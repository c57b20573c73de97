"""Sources of quillframe."""
