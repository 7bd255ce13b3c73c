"""Path language: parsing and compilation to columns."""
