"""Pluggable encoders. The library has no model: an encoder is a caller's function that turns a
DataFrame of distinct inputs into vectors, such as an iterator pandas_udf that loads its model once
per worker."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visret.functions.vectors import l2_normalized

#: prompt(prompt) -> (prompt, vec)
Encoder = Callable[[DataFrame], DataFrame]


def ensembles(rows: DataFrame, keys: list[str], encoder: Encoder) -> DataFrame:
    """keys and ``vec``: of each row's ``prompts`` the normalised mean vector. Every distinct
    prompt is encoded once, however many rows ask for it, and so is the mean of distinct prompts made.
    A row has a handful of prompts, so their vectors are brought together whole."""
    each = rows.select("prompts").distinct().select("prompts", F.explode("prompts").alias("prompt"))
    known = each.join(encoder(each.select("prompt").distinct()), "prompt").groupBy("prompts").agg(F.collect_list("vec").alias("vecs"))
    total = F.aggregate(F.slice("vecs", 2, 1 << 30), F.transform(F.col("vecs")[0], lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return rows.join(known.select("prompts", l2_normalized(total).alias("vec")), "prompts").select(*keys, "vec")


def missing(catalog: DataFrame, cached: DataFrame, model_id: str) -> DataFrame:
    """Rows of ``catalog`` for which ``cached(path, model_id, ...)`` has no vector of the model."""
    return catalog.join(cached.where(F.col("model_id") == model_id).select("path"), "path", "left_anti")


def backfilled(catalog: DataFrame, cached: DataFrame, model_id: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, model_id, embedding) of the whole catalogue; only what is missing is encoded."""
    have = cached.where(F.col("model_id") == model_id).join(catalog.select("path"), "path", "left_semi").select("path", "model_id", "embedding")
    new = encode(missing(catalog, cached, model_id)).select("path", F.lit(model_id).alias("model_id"), "embedding")
    return have.unionByName(new)
