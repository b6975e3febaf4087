"""Retrieval metrics, comparisons of runs and agreement of annotators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visret.operators.ordering import medians


def empty_judgments(judgments: DataFrame) -> DataFrame:
    """Rows of ``judgments(query, relevant_image_ids)`` that name no relevant image."""
    return judgments.where(F.coalesce(F.size("relevant_image_ids"), F.lit(-1)) <= 0)


def validated(judgments: DataFrame) -> DataFrame:
    if bad := empty_judgments(judgments).limit(1).collect():
        raise ValueError(f"no relevant images for {bad[0]['query']!r}")
    return judgments


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, reciprocal_rank, recall, ndcg) at ``k`` for every query of ``ranked(query_id,
    rank, image_id)``, against ``relevant(query_id, image_id)``. Without relevant images all are 0."""
    marks = relevant.select("query_id", "image_id").distinct()
    total = marks.groupBy("query_id").agg(F.count("*").alias("n"))
    return measured(ranked.where(F.col("rank") <= k).join(marks.withColumn("hit", F.lit(True)), ["query_id", "image_id"], "left"), total, k)


def metrics_by_label(ranked: DataFrame, images: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``metrics`` where an image of ``images(image_id, label)`` is relevant to each of
    ``queries(query_id, own, label)`` of the same label (null is none), but the query's own image.

    Their pairs, whose number is quadratic, are not made: relevant images are counted by label, and of
    the ranked ones the labels are looked up."""
    marks = images.where("label is not null").select("image_id", "label").distinct()
    counts = marks.groupBy("label").agg(F.count("*").alias("all"))
    own = queries.join(marks.select(F.col("image_id").alias("own"), "label", F.lit(1).alias("itself")), ["own", "label"], "left")
    total = own.join(counts, "label").select("query_id", (F.col("all") - F.coalesce("itself", F.lit(0))).alias("n")).where("n > 0")
    top = ranked.where(F.col("rank") <= k).join(queries, "query_id", "left").join(marks.withColumn("same", F.lit(True)), ["image_id", "label"], "left")
    return measured(top.withColumn("hit", F.col("same") & (F.col("image_id") != F.col("own"))), total, k)


def measured(top: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """Metrics of ``top(query_id, rank, image_id, hit)`` (null is no hit) and ``total(query_id, n)``."""
    top = top.withColumn("hit", F.coalesce("hit", F.lit(False)))
    per = top.groupBy("query_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.count_distinct(F.when(F.col("hit"), F.col("image_id"))).alias("hits"),
        F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.join(total, "query_id", "left").select(
        "query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(F.when(F.col("n") > 0, F.col("gain") / ideal), F.lit(0.0)).alias("ndcg"))


def macro(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("reciprocal_rank", "recall", "ndcg")])


def movement(structured: DataFrame, baseline: DataFrame) -> DataFrame:
    """(query_id, image_id, baseline_rank): the structured winner of each query and its rank in
    the baseline's whole pool, null outside of it."""
    return structured.where("rank = 1").select("query_id", "image_id").join(
        baseline.select("query_id", "image_id", F.col("rank").alias("baseline_rank")), ["query_id", "image_id"], "left")


def comparison(structured: DataFrame, baseline: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, image_id, baseline_rank, structured_top, baseline_top): ``movement`` and beside it
    the ids of the first ``depth`` of both, in order."""
    def top(run, name):
        first = run.where(F.col("rank") <= depth).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "image_id"))).alias("t"))
        return first.select("query_id", F.transform("t", lambda s: s["image_id"]).alias(name))

    return movement(structured, baseline).join(top(structured, "structured_top"), "query_id").join(top(baseline, "baseline_top"), "query_id", "left")


def time_summary(runs: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Mean, exact median and largest of ``seconds`` by ``keys``."""
    whole = runs.groupBy(*keys).agg(F.round(F.avg(seconds), 6).alias("mean_seconds"), F.round(F.max(seconds), 6).alias("max_seconds"))
    middle = medians(runs, keys, seconds, "median_seconds").withColumn("median_seconds", F.round("median_seconds", 6))
    return whole.join(middle, keys, "left").select(*keys, "mean_seconds", "median_seconds", "max_seconds")


def pool(runs: list[DataFrame], depth: int) -> DataFrame:
    """(query_id, image_id): every image among the first ``depth`` of any run."""
    out = None
    for r in runs:
        top = r.where(F.col("rank") <= depth).select("query_id", "image_id")
        out = top if out is None else out.unionByName(top)
    return out.distinct()


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of labels: agreement, chance agreement and kappa (null where
    chance alone agrees). Rows that lack either label are left out."""
    both = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = lambda c: both.groupBy(F.col(c).alias("l")).agg(F.sum("n").alias(f"n_{c}"))
    chance = side("a").join(side("b"), "l").agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("c"))
    whole = both.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("c", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return whole.crossJoin(chance).select("n", po.alias("agreement"), pe.alias("chance"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))  # a row each
