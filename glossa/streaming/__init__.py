"""The annotation job over arriving documents."""
