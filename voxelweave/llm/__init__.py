"""Operators that prepare training text: sharding, language, toxicity, joins,
extraction, search, mixing, media, packing and private data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
