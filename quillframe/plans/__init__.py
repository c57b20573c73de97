"""Plans of quillframe."""
