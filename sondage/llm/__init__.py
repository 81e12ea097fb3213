"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it, and the rest of the library works without it.
"""
