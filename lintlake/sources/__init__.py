"""Readers of source trees, project files, patches and settings."""
