"""Training-data operators: dedup, mixing, tokenising, scanning, scoring, sharding.

Nothing outside this subpackage (but corpus_pipeline.py and the guarded
import in __spark_entry__.py) depends on it.
"""
