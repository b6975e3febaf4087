"""Scores of candidates: region evidence, standardised within a query, joined by a smooth AND."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.functions import parse
from visret.functions.lexicon import DEFAULT, Lexicon
from visret.operators.candidates import arrow_type, fitting, matrix, unit_rows

# Weights of the scores.
PHRASE, GARMENT, MARGIN = 0.55, 0.30, 0.45
GLOBAL, AND, BINDING, OTHER, NEGATIVE = 0.15, 0.55, 0.20, 0.10, 0.20
TEMPERATURE, CLIP, FLAT = 0.35, 4.0, 1e-6
#: Means and deviations of up to so many groups (some 100 bytes each) are broadcast.
BROADCAST_GROUPS = 100_000


def standardized(x: Column, *keys: str) -> Column:
    """z-score among the rows of the same keys, clipped; 0 where they hardly vary."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(x).over(w)
    z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (x - F.avg(x).over(w)) / sd))
    return F.when(sd < FLAT, F.lit(0.0)).otherwise(z)


def standardized_rows(rows: DataFrame, value: str, keys: list[str], into: str) -> DataFrame:
    """``rows`` with the z-score of ``value`` as ``standardized`` makes it, for groups of any size:
    mean and deviation are aggregated and joined back."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("z_mean"), F.stddev_pop(value).alias("z_sd"))
    few = stats.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col(value) - F.col("z_mean")) / F.col("z_sd")))
    return (rows.join(F.broadcast(stats) if few else stats, keys)
            .withColumn(into, F.when(F.col("z_sd") < FLAT, F.lit(0.0)).otherwise(z)).drop("z_mean", "z_sd"))


def soft_min(z: Column, temperature: float = TEMPERATURE) -> Column:
    """Aggregate: a low value pulls the whole down. Safe unshifted, as scores are clipped."""
    return -temperature * F.log(F.avg(F.exp(-z / temperature)))


def parsed_queries(queries: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Texts parsed; each is normalized once, in a projection of its own, as the plan keeps apart what is
    dear and used more than once."""
    once = queries.select("query_id", "text", parse.normalized(F.coalesce("text", F.lit(""))).alias("normal"))
    return once.select("query_id", "text", *[c.alias(n) for n, c in parse.parsed(F.col("text"), lex, F.col("normal")).items()])


def query_colors(lex: Lexicon = DEFAULT) -> Column:
    """The colours of a parsed query's bindings."""
    return F.array_compact(F.transform("bindings", lambda b: parse.color_of(b, lex)))


def facets(parsed: DataFrame, *more: str) -> DataFrame:
    """(query_id, facet_no, kind, facet) with facets numbered from 1 in the order bindings,
    scenes, styles, actions, and ``more`` columns of the query."""
    of = lambda kind, c: F.transform(c, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("facet")))
    every = F.concat(of("binding", F.col("bindings")), of("scene", F.col("scenes")), of("style", F.col("styles")), of("action", F.col("actions")))
    return (parsed.select("query_id", *more, F.posexplode(every).alias("n", "f"))
            .select("query_id", (F.col("n") + 1).cast("int").alias("facet_no"), "f.kind", "f.facet", *more))


def whole_roles(queries: DataFrame) -> DataFrame:
    """Of the rows of ``roles`` those of whole queries (role full), for which none needs parsing."""
    return queries.select("query_id", F.lit(0).alias("facet_no"), F.lit("query").alias("kind"), F.lit("").alias("facet"), F.lit("full").alias("role"), F.lit(0).alias("role_no"),
                          parse.prompts(F.col("text"), "full").alias("prompts"))


def roles(parsed: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """(query_id, facet_no, kind, facet, role, role_no, prompts): every phrase of which a vector is
    needed. Facet 0 is the whole query (role full) and its negatives."""
    f = facets(parsed.withColumn("colors", query_colors(lex)), "colors")
    row = lambda role, no, kind, facet: F.struct(F.lit(role).alias("role"), no.cast("int").alias("role_no"), parse.prompts(facet, kind).alias("prompts"))
    one = F.lit(0)
    garment = parse.garment_of(F.col("facet"), lex)
    false = parse.distractors(parse.color_of(F.col("facet"), lex), garment, F.col("colors"), lex)
    bound = F.concat(F.array(row("phrase", one, "binding", F.col("facet")), row("garment", one, "garment", garment)),
                     F.transform(false, lambda d, i: row("distractor", i, "binding", d)))
    other = F.array(row("context", one, F.col("kind"), F.col("facet")))
    facet_roles = f.select("query_id", "facet_no", "kind", "facet", F.explode(F.when(F.col("kind") == "binding", bound).otherwise(other)).alias("r"))
    whole = F.concat(F.array(row("full", one, "full", F.col("text"))), F.transform("negatives", lambda n, i: row("negative", i, "negative", n)))
    query_roles = parsed.select("query_id", F.lit(0).alias("facet_no"), F.lit("query").alias("kind"), F.lit("").alias("facet"), F.explode(whole).alias("r"))
    return facet_roles.unionByName(query_roles).select("query_id", "facet_no", "kind", "facet", "r.*")


#: Bytes of role vectors and facets that are broadcast at a time; more queries take further passes.
ROLE_BYTES = 64 << 20
#: What a facet, a role of it and a facet of a query take besides the vectors, about.
FACET, ROLE, OWN = 600, 100, 16
#: Pairs of a row and a query that a task weighs at a time.
PAIRS = 1 << 18
EVIDENCE = ("phrase", "garment", "margin", "context")


@dataclass(frozen=True)
class Facet:
    """One facet as queries have it: its name, and by role the rows of the block's role vectors."""

    no: int
    kind: str
    facet: str
    at: dict[str, tuple[int, ...]]

    @property
    def whole(self) -> bool:
        """Whether it is about whole images."""
        return self.kind != "binding" and ("context" in self.at or "negative" in self.at)

    def weighed(self, x: np.ndarray, roles: np.ndarray, at: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """Scores by name of the unit vectors ``x``, each weighed once, at the places ``at``: of whole images,
        a place each, or of the regions of images, of which those of one image stand together from the
        places ``begin`` on."""
        dots = lambda role: x @ roles[list(self.at[role])].T
        if self.whole:
            return {"context": dots("context" if "context" in self.at else "negative").max(1)[at]}
        phrase, best = dots("phrase")[:, 0], lambda s: np.maximum.reduceat(s[at], begin)
        margin = best(phrase - dots("distractor").max(1)) if "distractor" in self.at else np.zeros(len(begin))
        return {"phrase": best(phrase), "garment": best(dots("garment")[:, 0]), "margin": margin}


@dataclass
class Block:
    """Some queries and the places of each one's facets. Facets and unit role vectors that queries have in
    common are there once."""

    keys: list
    own: list[np.ndarray]
    facets: list[Facet]
    roles: np.ndarray


def role_blocks(vectors: DataFrame, block_bytes: int) -> Iterator[Block]:
    """Queries with their facets and role vectors in blocks of a checked size (one query at least); only
    one block is on the driver at a time."""
    keys, own, facets, roles, size = [], [], {}, {}, 0
    done = lambda: Block(keys, own, [Facet(*f[:3], dict(f[3])) for f in facets], unit_rows([np.frombuffer(r) for r in roles]))
    rows = vectors.select("query_id", "facet_no", "kind", "facet", "role", "vec").orderBy("query_id", "facet_no", "kind", "facet", "role")
    for key, of in groupby(rows.toLocalIterator(), lambda r: r["query_id"]):
        named: dict[tuple, dict[str, list[bytes]]] = {}
        for r in of:
            named.setdefault((r["facet_no"], r["kind"], r["facet"]), {}).setdefault(r["role"], []).append(np.array(r["vec"], float).tobytes())
        needed = {v for at in named.values() for some in at.values() for v in some}
        count = sum(len(some) for at in named.values() for some in at.values())

        def here(roles=roles, facets=facets, named=named, needed=needed, count=count):
            new = [v for v in needed if v not in roles]
            facet = [(*name, tuple((role, tuple(roles.get(v, v) for v in some)) for role, some in at.items())) for name, at in named.items()]
            unseen = sum(f not in facets for f in facet)
            return sum(map(len, new)) + (FACET * unseen + ROLE * count if unseen else 0) + OWN * len(facet)

        more = here()
        if keys and size + more > block_bytes:
            yield done()
            keys, own, facets, roles, size = [], [], {}, {}, 0
            more = here(roles, facets)
        at = [(*name, tuple((role, tuple(roles.setdefault(v, len(roles)) for v in some)) for role, some in by.items())) for name, by in named.items()]
        own.append(np.array([facets.setdefault(f, len(facets)) for f in at], np.int32))
        keys.append(key)
        size += more
    if keys:
        yield done()


def weigher(shared, kind: pa.DataType, whole: bool):
    """For mapInArrow over (image_id, embedding, places of the queries it is a candidate of): what the
    rows of a batch say about each facet of each query, some pairs of a row and a query at a time."""
    schema = pa.schema([("query_id", kind), ("image_id", pa.string()), ("facet_no", pa.int32()), ("kind", pa.string()), ("facet", pa.string()), *[(n, pa.float64()) for n in EVIDENCE]])

    def some(rows: pa.RecordBatch, block: Block, keys: pa.Array, counts: np.ndarray, own: np.ndarray) -> Iterator[list]:
        """Columns of the schema, for each facet."""
        names, x, places = rows.column(0), unit_rows(matrix(rows.column(1))), rows.column(2)
        image = np.asarray(names.dictionary_encode().indices)
        row, of = np.repeat(np.arange(len(rows)), np.asarray(places.value_lengths())), np.asarray(places.flatten())
        order = np.lexsort((image[row], of))
        row, of = row[order], of[order]
        n = counts[of]  # facets of each pair
        pair = np.repeat(np.arange(len(of)), n)
        facet = own[np.repeat(np.cumsum(counts)[of] - n, n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.argsort(facet, kind="stable")
        pair, facet = pair[order], facet[order]
        cuts = np.r_[np.flatnonzero(np.diff(facet, prepend=-1)), len(facet)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            f, at = block.facets[facet[i]], pair[i:j]
            asked, seen = of[at], image[row[at]]
            begin = np.arange(len(at)) if whole else np.flatnonzero(np.r_[True, (np.diff(asked) != 0) | (np.diff(seen) != 0)])
            used, place = np.unique(row[at], return_inverse=True)  # a row that many queries of the facet have, once
            got = f.weighed(x[used], block.roles, place, begin)
            m = len(begin)
            yield [keys.take(pa.array(asked[begin])), names.take(pa.array(row[at][begin])).cast(pa.string()), pa.array(np.full(m, f.no, np.int32)),
                   pa.repeat(f.kind if "negative" not in f.at or "context" in f.at else "negative", m), pa.repeat(f.facet, m),
                   *[pa.array(got[c]) if c in got else pa.nulls(m, pa.float64()) for c in EVIDENCE]]

    def weigh(batches):
        block = shared.value
        keys = pa.array(block.keys, kind)
        own = [np.array([i for i in o if block.facets[i].whole == whole and (whole or block.facets[i].kind == "binding")], np.int32) for o in block.own]
        counts, own = np.array([len(o) for o in own]), np.concatenate(own)
        for batch in batches:
            batch = batch.filter(pa.array(fitting(batch.column(1), block.roles.shape[1])))
            part = np.cumsum(np.asarray(batch.column(2).value_lengths())) // PAIRS
            cuts = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
            parts, n = [], 0
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                for columns in some(batch.slice(i, j - i), block, keys, counts, own):
                    parts.append(pa.RecordBatch.from_arrays(columns, schema=schema))
                    n += len(parts[-1])
                    if n >= 10_000:
                        yield from pa.Table.from_batches(parts, schema).combine_chunks().to_batches(10_000)
                        parts, n = [], 0
            if parts:
                yield from pa.Table.from_batches(parts, schema).combine_chunks().to_batches(10_000)

    return weigh


def evidence(candidates: DataFrame, images: DataFrame, regions: DataFrame, vectors: DataFrame, *, block_bytes: int = ROLE_BYTES) -> DataFrame:
    """(query_id, image_id, facet_no, kind, facet, phrase, garment, margin, context): what the
    regions of each candidate say about each facet.

    phrase and garment are the best regions' cosines, margin the best surplus of a region's phrase
    over its own best distractor (0 without distractors), context the cosine of the whole image,
    also for the largest negative (kind ``negative``, facet 0). Real regions only, however many an
    image has.

    Candidates travel to where images and regions are, as ids; role vectors are broadcast in blocks of
    a checked size. Over an index that is bucketed by image no vector is shuffled.
    """
    spark, kind = candidates.sparkSession, T.StructType([candidates.schema["query_id"]])
    names = ", ".join(f"{n} double" for n in EVIDENCE)
    schema, out = f"query_id {kind[0].dataType.simpleString()}, image_id string, facet_no int, kind string, facet string, {names}", None
    for block in role_blocks(vectors, block_bytes):
        own = spark.createDataFrame([(k, i) for i, k in enumerate(block.keys)], T.StructType([kind[0], T.StructField("place", T.IntegerType())]))
        asked = candidates.select("query_id", "image_id").distinct().join(F.broadcast(own), "query_id").groupBy("image_id").agg(F.collect_list("place").alias("places"))
        shared = spark.sparkContext.broadcast(block)
        for table, whole in ((images, True), (regions, False)):
            near = table.select("image_id", "embedding").join(asked, "image_id").select("image_id", "embedding", "places")
            part = near.mapInArrow(weigher(shared, arrow_type(kind), whole), schema)
            out = part if out is None else out.unionByName(part)
    # All four are maxima over regions, wherever those of an image are. Ranking needs a query's rows
    # together, so this is the exchange for both.
    out = spark.createDataFrame([], schema) if out is None else out.repartition("query_id")
    return out.groupBy("query_id", "image_id", "facet_no", "kind", "facet").agg(*[F.max(n).alias(n) for n in EVIDENCE])


def raw_scores(found: DataFrame) -> DataFrame:
    """(query_id, image_id, facet_no, kind, facet, raw) of facets and, as kind negative, of the
    worst negative."""
    bound = PHRASE * F.col("phrase") + GARMENT * F.col("garment") + MARGIN * F.col("margin")
    return found.select("query_id", "image_id", "facet_no", "kind", "facet", F.when(F.col("kind") == "binding", bound).otherwise(F.col("context")).alias("raw"))


def ranked(candidates: DataFrame, raw: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, image_id, score, global_score, conjunction_score, facet_scores): the ``k``
    best of each query's candidates; facet_scores maps kind:facet to its z-score."""
    if k < 1:
        raise ValueError("k must be positive")
    base = candidates.select("query_id", "image_id", "cand_rank", standardized(F.col("cosine"), "query_id").alias("zg"))
    z = raw.withColumn("z", standardized(F.col("raw"), "query_id", "facet_no", "kind"))
    is_facet, bound = F.col("kind") != "negative", F.col("kind") == "binding"
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("z"))), F.lit(0.0))
    names = F.array_sort(F.collect_list(F.when(is_facet, F.struct("facet_no", F.concat_ws(":", "kind", "facet").alias("name"), F.round("z", 4).alias("z")))))
    per = z.groupBy("query_id", "image_id").agg(
        soft_min(F.when(is_facet, F.col("z"))).alias("both"), mean(bound).alias("bound"), mean(is_facet & ~bound).alias("other"),
        F.greatest(F.max(F.when(~is_facet, F.col("z"))), F.lit(0.0)).alias("neg"), names.alias("names"))
    neg = F.coalesce("neg", F.lit(0.0))
    both = F.coalesce("both", "zg")
    final = F.when(F.col("both").isNull(), F.col("zg") - NEGATIVE * neg).otherwise(
        GLOBAL * F.col("zg") + AND * F.col("both") + BINDING * F.col("bound") + OTHER * F.col("other") - NEGATIVE * neg)
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "cand_rank")
    scored = base.join(per, ["query_id", "image_id"], "left").withColumn("final", final).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scored.select("query_id", "rank", "image_id", F.round("final", 6).alias("score"), F.round("zg", 6).alias("global_score"), F.round(both, 6).alias("conjunction_score"),
                         F.map_from_entries(F.transform(F.coalesce("names", F.array()), lambda s: F.struct(s["name"], s["z"]))).alias("facet_scores"))


def ranked_globally(candidates: DataFrame, k: int) -> DataFrame:
    """As ``ranked`` by the whole image alone."""
    if k < 1:
        raise ValueError("k must be positive")
    z = F.round(standardized(F.col("cosine"), "query_id"), 6)
    return (candidates.withColumn("score", z).where(F.col("cand_rank") <= k)
            .select("query_id", F.col("cand_rank").alias("rank"), "image_id", "score", F.col("score").alias("global_score"), F.col("score").alias("conjunction_score"),
                    F.create_map().cast("map<string,double>").alias("facet_scores")))
