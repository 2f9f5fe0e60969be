"""sentspark: Spark-native building blocks for sentence-embedding corpora,
features, contrastive scoring and STS evaluation.

Every public operator is a ``DataFrame -> DataFrame`` function written with
native Spark expressions; Arrow/numpy batches are used only where bulk vector
arithmetic (matrix products) calls for it.
"""

__version__ = "0.1.0"
