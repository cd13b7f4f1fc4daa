"""Operators that prepare text for training language models.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
