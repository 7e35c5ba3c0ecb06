"""Operators for preparing text for language models. Nothing outside this package imports it."""
