"""plyforge: a PySpark-native engine for sequence corpora.

Operators are ``DataFrame -> DataFrame`` functions over Spark SQL; Python runs
only inside Arrow batches, where a domain kernel (board replay, tokenizers,
progressive alignment, rating fits) has no native expression.
"""

__version__ = "0.1.0"
