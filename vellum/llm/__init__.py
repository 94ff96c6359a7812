"""Training-data operators on Spark: near-duplicate search, packing, line removal, token counting,
top-k search, tokenisation, toxicity, personal data and binary token files.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
