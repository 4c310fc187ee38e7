"""Training-data operators: tokens, dedup, filtering, packing and sharding.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
