"""Operators for preparing language-model training data.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  Each
module holds one operator with a general interface; ``queries`` holds the thin
contract queries that apply them to the project's tables.
"""
