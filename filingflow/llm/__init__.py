"""Operators for building training corpora from large text tables.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
