"""User models in Arrow batches (row 106): loaded once per Python worker, fed with numpy batches.

``make_predict`` is called on the worker and returns ``predict(texts) -> array``: one probability per text for a
classifier, one vector per text for an embedder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 1024


def batch_classifier(make_predict: Callable, text_col: str = "line_contents", batch_size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A ``classify_fn`` for ``review``: adds ``commented_prob``, null text is scored as ''."""
    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size)
    return lambda df: df.withColumn("commented_prob", predict(F.coalesce(F.col(text_col), F.lit(""))))


def batch_embedder(make_predict: Callable, batch_size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """An ``embed_fn`` for ``review``: ``line`` -> ``line, embedding``."""
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda df: df.select("line", predict(F.coalesce(F.col("line"), F.lit(""))).alias("embedding"))
