"""Relational operators over notes, spans, medications and review tables."""
