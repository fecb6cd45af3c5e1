"""Training-data operators (deduplication, filtering, tokenisation) on Spark.

Nothing outside this subpackage imports it.
"""
