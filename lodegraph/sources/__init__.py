"""Readers: source trees, resource files, evaluation sets, settings."""
