"""Input tables: word dumps, Markdown by page marker, and layouts laid on plain documents."""
