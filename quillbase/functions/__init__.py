"""Part of quillbase."""
