"""Operators for preparing training data for language models.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
