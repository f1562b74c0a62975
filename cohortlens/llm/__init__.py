"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Each module holds one operator with
its own general interface; the thin registered queries are in :mod:`cohortlens.llm.queries`.
"""
