"""Vectors as array columns: norms, products and means as expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """Unit vector in double; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x.cast("double") / n)


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def audit(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: vectors, whether all are finite and of unit norm, least and largest length."""
    v = F.col(column)
    return df.agg(
        F.count("*").alias("vectors"), F.bool_and(F.coalesce(finite(v), F.lit(False))).alias("all_finite"),
        F.bool_and(F.abs(norm(v) - 1) < 1e-3).alias("all_unit"), F.min(F.size(v)).alias("min_dimension"), F.max(F.size(v)).alias("max_dimension"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys and ``vec``: the normalised mean of each key's vectors. Sums are made per dimension, so
    a key with very many vectors is added up before the shuffle."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("all"))
    return whole.select(*keys, l2_normalized(F.transform("all", lambda s: s["x"])).alias("vec"))
