"""Training-data operators: dedup, mixing, packing, token output, extraction, language ID.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
