"""Relational operators on long (group, item, label, score) tables."""
