"""Ranks, medians and bests within groups of which one may hold most rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visret.sources.lineage import cut

#: Groups (some 100 bytes each) whose bounds are broadcast at most.
BROADCAST = 100_000
BEST = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("id", pa.string())])


def kept(rows: pa.Table, k: int, one_each: bool = False) -> pa.Table:
    """Of rows (key, score, id) the ``k`` of the largest score of each key, ties by id, in that
    order; with ``one_each`` an id counts once, by its best row."""
    order = [("key", "ascending"), ("score", "descending"), ("id", "ascending")]
    if one_each:
        rows = rows.group_by(["key", "id"]).aggregate([("score", "max")]).rename_columns({"score_max": "score"}).select(BEST.names)
    rows = rows.sort_by(order)
    key = rows["key"].to_numpy()
    return rows.filter(pa.array(np.arange(len(key)) - np.searchsorted(key, key) < k))


def best_rows(rows: DataFrame, key: str, score: str, name: str, k: int) -> DataFrame:
    """(key, score, name) of ``rows``, each task's ``k`` best of every key (a long) only."""
    def best(batches):
        held = None
        for batch in batches:
            new = pa.table({n: batch.column(i).cast(BEST.field(n).type) for i, n in enumerate(BEST.names)})
            held = kept(new if held is None else pa.concat_tables([held, new]), k)
        if held is not None:
            yield from held.rename_columns([key, score, name]).to_batches(10_000)

    return rows.select(F.col(key).cast("long"), F.col(score).cast("double"), F.col(name).cast("string")).mapInArrow(best, f"{key} long, {score} double, {name} string")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], into: str) -> DataFrame:
    """``rows`` with their number from 1 within the rows of the same ``keys`` in the given order.

    Rows are dealt by ranges of keys and order, so that a group of any size is spread over tasks;
    to its number within its part a row adds the group's rows in earlier parts."""
    parts = cut(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("part", F.spark_partition_id()))
    here = parts.groupBy(*keys, "part").agg(F.count("*").alias("n"))  # a row for each part of a group
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = here.select(*keys, "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    return parts.withColumn("inside", inside).join(offset, [*keys, "part"]).withColumn(into, F.col("inside") + F.col("before")).drop("part", "inside", "before")


#: Bins that the values of a group are counted in at a time.
BINS = 4096


def medians(rows: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """keys and the exact median of ``value`` (nulls left out).

    The values in the middle are selected by counts: values between a group's bounds are counted in
    bins, the bin that holds the middle one is found, and its least and largest value are the bounds of
    the next count, until both are one value. So rows are neither sorted nor kept, only aggregated, and
    a count of a group has ``BINS`` rows; each makes the bounds some thousand times as narrow. NaN is
    larger than all other values."""
    x = F.col(value).cast("double")
    # Infinities and NaN are put beside the other values, so that bins can be reckoned.
    apart = F.when(F.isnan(x), 2).when(x == float("inf"), 1).when(x == float("-inf"), -1).otherwise(0)
    some = rows.where(F.col(value).isNotNull()).select(*keys, apart.alias("kind"), F.when(apart == 0, x).otherwise(0.0).alias("x"))
    edges = [F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    each = [F.col(k) for k in keys]
    bins = some.groupBy(*keys, "kind").agg(*edges).withColumn("bin", F.lit(0))
    n = bins.groupBy(*keys).agg(F.sum("c").alias("n"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))).alias("at")
    targets = cut(within(bins, n.select(*keys, F.col("n"), middle), keys, ["kind", "bin"]))
    done = None
    while True:
        found = targets.where("lo >= hi")
        done = found if done is None else done.unionByName(found)
        targets = targets.where("lo < hi")
        left = targets.count()
        if not left:
            break
        wanted = targets.select(*keys, "kind", "at", "n", "before", "lo", "hi")
        part = some.join(F.broadcast(wanted) if left <= BROADCAST else wanted, [*keys, "kind"]).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        # Halves of large ones, as the distance of two doubles may be more than the largest.
        half = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e307, 0.5).otherwise(1.0)
        place = F.least(F.lit(BINS - 1), F.floor((F.col("x") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half) * BINS).cast("int"))
        counted = part.groupBy(*keys, "kind", "at", "n", "before", place.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        targets = cut(within(counted, None, [*keys, "kind", "at", "n", "before"], ["bin"]))
    out = F.when(F.col("kind") == 2, float("nan")).when(F.col("kind") == 1, float("inf")).when(F.col("kind") == -1, float("-inf")).otherwise(F.col("lo"))
    return done.select(*each, out.alias("v")).groupBy(*keys).agg(F.avg("v").alias(into))


def within(bins: DataFrame, targets: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Of counted ``bins``, in ``order`` within ``keys``, the one that holds each place ``at`` that is
    wanted (counted from ``before``), with the places before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = bins.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0)))
    if targets is not None:
        earlier = earlier.join(targets, keys).withColumn("before", F.lit(0).cast("long"))
    begin = F.col("before") + F.col("below")
    here = earlier.where((F.col("at") > begin) & (F.col("at") <= begin + F.col("c")))
    names = [k for k in keys if k not in ("kind", "at", "n", "before")]
    return here.select(*names, "kind", "at", "n", begin.alias("before"), "lo", "hi")
