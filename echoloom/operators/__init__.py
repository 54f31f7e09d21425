"""Relational operators: windows, splits, quality, discrimination, selection, gates, localisation."""
