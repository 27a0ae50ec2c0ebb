"""Operators for large text corpora: search, tokenising, cleaning, packing, sharding, near-duplicates.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
