"""Operators for training-data pipelines: text in, decisions, statistics and token ids out.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
