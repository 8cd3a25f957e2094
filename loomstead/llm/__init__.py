"""Training-data operators: packing, archives, media, extraction, scoring, deduplication, tokens.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
