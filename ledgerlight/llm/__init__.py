"""Operators for building and cleaning text corpora.

Nothing outside this subpackage imports it.
"""
