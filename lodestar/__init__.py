"""lodestar: dense retrieval, re-ranking, weak supervision and ranking evaluation on Spark.

Every public operator is a function from DataFrames (plus plain parameters) to a lazy DataFrame.
Nothing in the core calls ``collect()``; sizes that decide a broadcast are checked first.
"""

__version__ = "0.1.0"
