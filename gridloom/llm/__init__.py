"""Operators for building large text-training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
