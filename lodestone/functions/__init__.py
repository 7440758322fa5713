"""Subpackage of lodestone; see README.md."""
