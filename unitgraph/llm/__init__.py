"""Operators for preparing language-model training data (optional subpackage)."""
