"""Corpus operators for training-data pipelines.

Nothing outside this package imports it; deleting it leaves the rest of the library whole.
"""
