"""Training-data operators: archives, deduplication, scoring, filtering, mixing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only if it can be imported.
"""
