"""Training-data operators: dedup, scoring, filtering, formatting and packing of text corpora.

Nothing outside this subpackage imports it.
"""
