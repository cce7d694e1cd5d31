"""Operators of a training-data pipeline over large text corpora.

Nothing outside this subpackage imports it.
"""
