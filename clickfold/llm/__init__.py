"""Training-data operators: language ID, near-duplicate detection, search, tokenising, extraction.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Each module holds one
operator with its own general interface; ``queries.py`` maps the operators onto the test tables.
"""
