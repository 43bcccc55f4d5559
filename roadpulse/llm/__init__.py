"""Operators of a training-data pipeline: quality, duplicates, extraction, packing, tokens.

Nothing else in the library imports this subpackage.
"""
