"""Curation: unique images for facets with quotas, and reports about them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visret.operators.ordering import best_rows, medians, numbered
from visret.sources.lineage import cut

# Axis, name, prompts and quota of the default facets.
COVERAGE = (
    ("environment", "modern office", ("professional fashion photo inside a modern office", "person in an office interior", "corporate workplace fashion"), 80),
    ("environment", "urban street", ("street-style fashion on an urban sidewalk", "person walking on a city street", "downtown fashion photo"), 80),
    ("environment", "park", ("fashion photo in a green park", "person near a park bench", "outfit photographed in a garden"), 80),
    ("environment", "home", ("casual fashion photo inside a home", "person in a living room", "outfit photographed in a home interior"), 80),
    ("clothing", "formal", ("formal business attire with blazer or suit", "professional button-down outfit", "elegant formal clothing"), 80),
    ("clothing", "casual", ("casual weekend outfit with t-shirt or hoodie", "relaxed everyday clothing", "casual streetwear"), 80),
    ("clothing", "outerwear", ("person wearing outerwear", "fashion photo of a coat or raincoat", "layered jacket outfit"), 80),
    ("color", "black", ("person wearing black clothing", "black fashion outfit"), 40),
    ("color", "white", ("person wearing white clothing", "white fashion outfit"), 40),
    ("color", "red", ("person wearing red clothing", "red fashion outfit"), 40),
    ("color", "blue", ("person wearing blue clothing", "blue fashion outfit"), 40),
    ("color", "yellow", ("person wearing yellow clothing", "bright yellow fashion outfit"), 40),
    ("color", "green", ("person wearing green clothing", "green fashion outfit"), 40),
    ("color", "orange", ("person wearing orange clothing", "orange fashion outfit"), 40),
    ("color", "purple", ("person wearing purple clothing", "purple fashion outfit"), 40),
    ("color", "pink", ("person wearing pink clothing", "pink fashion outfit"), 40),
    ("color", "brown", ("person wearing brown clothing", "brown fashion outfit"), 40),
    ("color", "beige", ("person wearing beige clothing", "beige or cream fashion outfit"), 40),
)


def default_facets(spark) -> DataFrame:
    """(facet_no, axis, name, prompts, quota)."""
    return spark.createDataFrame([(i, axis, name, list(prompts), quota) for i, (axis, name, prompts, quota) in enumerate(COVERAGE)], "facet_no long, axis string, name string, prompts array<string>, quota int")


def rankings(scores: DataFrame, most: int | None = None) -> DataFrame:
    """``scores(image_id, facet_no, score)`` with ``rank`` within the facet, ties by image_id; with
    ``most`` only that many of each facet, cut in every task before the shuffle. All ranks are made
    by ranges, so that a facet's images are never in one task."""
    if most is None:
        return numbered(scores, ["facet_no"], [F.desc("score"), F.asc("image_id")], "rank")
    w = Window.partitionBy("facet_no").orderBy(F.desc("score"), "image_id")
    short = best_rows(scores, "facet_no", "score", "image_id", most).select("image_id", "facet_no", "score")
    return short.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Rows (image, facet) that the task which picks has at a time.
AT_ONCE = 1 << 21
PICKS = "pick_no long, image_id string, facet_no long, score double, rank int"


def turns(quotas: list[int], most: int) -> Iterator[tuple[int, int, int]]:
    """Turns cut into runs of ``most`` picks at most (one turn at least): first turn, last (excluded) and
    how many picks it has. A turn has a pick of every facet with quota left."""
    ends = np.sort(np.array(quotas))
    first, last = 0, int(ends[-1]) if len(ends) else 0
    while first < last:
        each = int((ends > first).sum())  # facets that still pick in the first turn of the run
        end = min(last, first + max(1, most // each))
        yield first, end, int(np.clip(ends - first, 0, end - first).sum())
        first = end


def picker(quotas: dict[int, int], first: int, end: int, before: int):
    """For applyInArrow over the best images, by facet, that are still free: the picks of the turns from
    ``first`` to ``end``, numbered after the ``before`` earlier ones."""
    return lambda table: picked(table, quotas, first, end, before)


def picked(table: pa.Table, quotas: dict[int, int], first: int, end: int, before: int) -> pa.Table:
    image = table["image_id"].combine_chunks().dictionary_encode()
    code, facet, rank = np.asarray(image.indices), table["facet_no"].to_numpy(), table["rank"].to_numpy()
    order = np.lexsort((rank, facet))
    edges = {f: np.searchsorted(facet[order], [f, f + 1]) for f in quotas}
    at, used, out = {f: int(e[0]) for f, e in edges.items()}, np.zeros(len(image.dictionary), bool), []
    for turn in range(first, end):
        for f, quota in quotas.items():
            if turn < quota:
                i = at[f]
                while used[code[order[i]]]:
                    i += 1
                used[code[order[i]]] = True
                out.append(order[i])
                at[f] = i + 1
    rows = table.select(["image_id", "facet_no", "score", "rank"]).take(pa.array(np.array(out, np.int64)))
    return rows.add_column(0, "pick_no", pa.array(np.arange(before + 1, before + 1 + len(out))))


def allocated(scores: DataFrame, facets: DataFrame, *, at_once: int = AT_ONCE) -> DataFrame:
    """(pick_no, image_id, facet_no, score, rank): in rounds, every facet of
    ``facets(facet_no, quota)`` with quota left takes its best image that no one has taken.

    Turns are taken in runs. Before any pick of a run fewer images than the run has picks are taken in
    it, so each is among so many first free images of its facet and only those are looked at: facets x
    picks of the run, ``at_once`` rows in the one task that picks, whatever the quotas are. Fewer images
    than the sum of quotas are an error.
    """
    quotas = {r[0]: max(0, r[1]) for r in facets.select("facet_no", "quota").orderBy("facet_no").collect()}
    spark, need = scores.sparkSession, sum(quotas.values())
    have = scores.select("image_id").distinct().limit(need).count()
    if have < need:
        raise ValueError(f"{need} images are needed, {have} are there")
    own = scores.join(F.broadcast(facets.select("facet_no")), "facet_no").select("facet_no", "image_id", "score")
    runs = list(turns(list(quotas.values()), max(1, at_once // max(1, len(quotas)))))
    if not runs:
        return spark.createDataFrame([], PICKS)
    ranked = rankings(own, need) if len(runs) == 1 else cut(rankings(own).where(F.col("rank") <= need))
    ranked, out, before = ranked.select("facet_no", F.col("rank").cast("int").alias("rank"), "image_id", "score"), None, 0
    for first, end, n in runs:
        free = ranked if out is None else ranked.join(out.select("image_id"), "image_id", "left_anti")
        if len(runs) > 1:  # the first n free ones of each facet, cut in every task before the shuffle
            best = best_rows(free.withColumn("order", -F.col("rank").cast("double")), "facet_no", "order", "image_id", n).select("facet_no", "image_id", (-F.col("order")).cast("int").alias("rank"))
            top = best.withColumn("n", F.row_number().over(Window.partitionBy("facet_no").orderBy("rank"))).where(F.col("n") <= n).select("facet_no", "image_id")
            free = free.join(top, ["facet_no", "image_id"])
        picks = free.groupBy(F.lit(1).alias("all")).applyInArrow(picker(quotas, first, end, before), PICKS)
        out, before = picks if len(runs) == 1 else cut(picks if out is None else out.unionByName(picks)), before + n
    return out


def counts(picks: DataFrame, facets: DataFrame) -> DataFrame:
    return picks.join(facets.select("facet_no", "axis", "name"), "facet_no").groupBy("axis", F.col("name").alias("label")).agg(F.count("*").alias("n"))


def report(scores: DataFrame, facets: DataFrame, top: int = 8) -> DataFrame:
    """A row per facet: its fields, largest and median score and the ``top`` best images."""
    whole = scores.groupBy("facet_no").agg(F.round(F.max("score"), 6).alias("maximum"))
    middle = medians(scores, ["facet_no"], "score", "median").withColumn("median", F.round("median", 6))
    best = (rankings(scores, top).groupBy("facet_no")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "image_id", F.round("score", 6).alias("score")))).alias("best")))
    return facets.join(whole, "facet_no").join(middle, "facet_no").join(best, "facet_no")
