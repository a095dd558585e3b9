"""Layout operators over words, lines and blocks."""
