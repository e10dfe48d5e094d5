"""Training-data operators: filtering, deduplication, tokenisation and scoring of text corpora.

Nothing outside this package imports it.
"""
