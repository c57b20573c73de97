"""Functions of quillframe."""
