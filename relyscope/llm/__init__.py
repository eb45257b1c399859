"""Training-data pipeline operators (quality, language, toxicity, URLs, line
deduplication, packing, sharding, mixing, top-k search, Jaccard join).

Nothing outside this subpackage imports it except the guarded import in
``__spark_entry__.py``; ``corpus_pipeline.py`` chains five of its operators.
"""
