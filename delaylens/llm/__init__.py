"""Training-data operators: filtering, search, near-duplicates, packing, formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
