"""Column functions on text and geometry."""
