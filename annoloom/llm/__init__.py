"""Training-data operators: mixing, filtering, redaction, deduplication, extraction, tokenisation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
