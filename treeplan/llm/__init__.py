"""Operators for training-data pipelines.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; each
module holds one operator, ``queries.py`` the thin query of each.
"""
