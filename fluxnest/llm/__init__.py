"""Operators for text corpora and identifier sets; nothing outside this subpackage imports it."""
