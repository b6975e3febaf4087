"""Overlaps of intervals of two tables, without pairs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visret.sources.lineage import cut


def outside(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """The rows of ``a`` whose interval, from ``start`` to ``end`` (integers, the end excluded), overlaps
    none of ``b`` with the same ``keys``; rows with a null key or bound, and empty intervals, overlap
    nothing.

    Intervals are dealt to bins of ``width``, so that a key of most rows is spread over tasks; an interval
    is in every bin that it touches. A bin is swept once in order of a's ends and b's starts: an interval
    of a is overlapped if the farthest end of those that b has begun before its end lies behind its
    start. An interval of a bin is looked at once, however many overlap it.
    """
    own = "row"
    while own in a.columns:
        own += "_"
    rows = cut(a.withColumn(own, F.monotonically_increasing_id()))
    dealt = lambda d: d.where(F.col(start) < F.col(end)).withColumn("bin", F.explode(F.sequence(
        F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    none = F.lit(None).cast("long")
    events = dealt(rows).select(*keys, "bin", F.col(end).cast("long").alias("at"), F.lit(0).alias("side"), F.col(own).alias("row"), F.col(start).cast("long").alias("begin"), none.alias("reach")).unionByName(
        dealt(b).select(*keys, "bin", F.col(start).cast("long").alias("at"), F.lit(1).alias("side"), none.alias("row"), none.alias("begin"), F.col(end).cast("long").alias("reach")))
    for k in keys:
        events = events.where(F.col(k).isNotNull())
    w = Window.partitionBy(*keys, "bin").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = events.withColumn("far", F.max("reach").over(w)).where("side = 0 and far > begin").select(F.col("row").alias(own)).distinct()
    return rows.join(hit, own, "left_anti").select(a.columns)
