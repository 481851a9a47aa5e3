"""Relational operators of annotation, linking and vocabulary curation, from DataFrame to DataFrame."""
