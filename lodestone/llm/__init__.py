"""Operators on texts and sources for training data. Nothing outside this subpackage imports it."""
