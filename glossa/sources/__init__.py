"""Readers of documents and vocabularies, and writers of annotated documents and reports."""
