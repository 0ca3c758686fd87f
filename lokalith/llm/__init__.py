"""Training-data operators: cleaning, de-duplication, packing and counting of text corpora.

Nothing outside this subpackage imports it.
"""
