"""Part of quillspark; see the README for the layout."""
