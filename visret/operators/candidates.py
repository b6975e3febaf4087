"""Candidates of a table of query vectors in a table of image vectors, by cosine."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that are broadcast at a time, and rows of best images that a task keeps
#: for them (approximate search: of codes); more queries take more passes.
BLOCK_BYTES, KEPT_ROWS, BEST_ROWS = 64 << 20, 1 << 19, 1 << 21
#: Cosines that a task has at a time.
AT_ONCE = 1 << 20
#: Rows that wait at least before they are held against those that a task keeps.
WAITING = 1 << 16
#: Bytes of the sample that cells are fitted on, and images of a cell aimed at.
SAMPLE_BYTES, CELL = 16 << 20, 256


def fitting(column: pa.Array, width: int) -> np.ndarray:
    """Which vectors of a list column are not null and of the given length."""
    return np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), width), False).to_numpy(zero_copy_only=False), bool)


def matrix(column) -> np.ndarray:
    """A list column of vectors of one length, without nulls, as rows in double."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def unit_rows(rows) -> np.ndarray:
    """Rows as unit vectors in double; zero rows stay zero."""
    x = np.asarray(rows, float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cosines(q: np.ndarray, rows) -> np.ndarray:
    """To 12 digits, so that equal vectors tie whatever the order of the sums."""
    return np.round(q @ unit_rows(rows).T, 12)


def query_blocks(queries: DataFrame, key: str, block_bytes: int, most: int = 1 << 62) -> Iterator[tuple[list, np.ndarray]]:
    """Keys and unit vectors of ``queries(key, vec)`` in blocks of a checked size, ``most`` rows at
    most; only one of them is on the driver at a time."""
    keys, rows, size = [], [], 0
    for r in queries.select(key, "vec").toLocalIterator():
        if rows and (size + 8 * len(r[1]) > block_bytes or len(r[1]) != len(rows[0]) or len(rows) >= most):
            yield keys, unit_rows(rows)
            keys, rows, size = [], [], 0
        keys.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1])
    if rows:
        yield keys, unit_rows(rows)


class Best:
    """A task's ``k`` best ids of every query of a block, ties by id; with ``one_each`` an id counts by its
    best row.

    Rows that reach a query's k-th best wait in plain numbers (16 bytes each, and the ids they name) and
    are held against the kept ones when they are as many, so that memory goes by queries and ``k`` and not
    by the images that are seen, and a row is sorted a few times at most."""

    def __init__(self, q: np.ndarray, k: int, one_each: bool = False):
        self.q, self.k, self.one_each = q, k, one_each
        self.floor = np.full(len(q), -np.inf)
        self.names, self.rows, self.named, self.waiting = [], [], 0, 0

    def look(self, ids: pa.Array, x: np.ndarray, asked: np.ndarray | None = None) -> None:
        """At images of unit vectors ``x``, for all queries or those at the places ``asked``."""
        asked = np.arange(len(self.q)) if asked is None else asked
        q = self.q[asked]
        step = max(1, AT_ONCE // max(1, len(asked)))
        for i in range(0, len(x) if len(asked) else 0, step):
            score = q @ x[i:i + step].T
            a, b = np.nonzero(score >= self.floor[asked][:, None] - 1e-12)  # which rounding may still lift to it
            if len(a):
                used, at = np.unique(b, return_inverse=True)
                self.names.append(ids.take(pa.array(used + i)).cast(pa.string()))
                # To 12 digits, so that equal vectors tie whatever the order of the sums.
                self.rows.append((asked[a].astype(np.int32), np.round(score[a, b], 12), (at + self.named).astype(np.int32)))
                self.named += len(used)
                self.waiting += len(a)
            if self.waiting >= max(WAITING, min(len(self.q) * self.k, KEPT_ROWS)):
                self.keep()

    def keep(self) -> None:
        key, score, at = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows.clear()
        used, at = np.unique(at, return_inverse=True)
        coded = pa.concat_arrays(self.names).take(pa.array(used)).dictionary_encode(null_encoding="encode")
        order = pa.compute.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        at = rank[coded.indices.to_numpy()][at]
        if self.one_each:
            own = np.lexsort((-score, at, key))
            own = own[np.r_[True, (np.diff(key[own]) != 0) | (np.diff(at[own]) != 0)]]
            key, score, at = key[own], score[own], at[own]
        own = np.lexsort((at, -score, key))
        have = np.bincount(key, minlength=len(self.q))
        own = own[np.arange(len(own)) - np.repeat(np.cumsum(have) - have, have) < self.k]
        self.rows.append((key[own], score[own], at[own]))
        have = np.minimum(have, self.k)
        full = have == self.k
        self.floor[full] = score[own][np.cumsum(have)[full] - 1]
        self.names, self.named, self.waiting = [coded.dictionary.take(order)], len(order), 0

    def found(self, keys: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.keep()
        key, score, at = self.rows[0]
        for i in range(0, len(key), 10_000):
            some = slice(i, i + 10_000)
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[n] for n in key[some]], kind), self.names[0].take(pa.array(at[some])), pa.array(score[some])], ["query_id", "image_id", "cosine"])


def local_best(shared, k: int, kind: pa.DataType, one_each: bool = False):
    """For mapInArrow over (id, embedding): each task's ``k`` best ids of every query of the block,
    ties by id, so that no more than tasks x queries x k rows are shuffled."""
    def best(batches):
        keys, q = shared.value
        held = Best(q, k, one_each)
        for batch in batches:
            fits = fitting(batch.column(1), q.shape[1])
            if fits.any():
                batch = batch.filter(pa.array(fits))
                held.look(batch.column(0), unit_rows(matrix(batch.column(1))))
        yield from held.found(keys, kind)

    return best


def found_by(images: DataFrame, queries: DataFrame, k: int, block_bytes: int, one_each: bool) -> DataFrame:
    """(query_id, image_id, cosine): the best of every task."""
    if k < 1:
        raise ValueError("k must be positive")
    spark, out = images.sparkSession, None
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("image_id", T.StringType()), T.StructField("cosine", T.DoubleType())])
    for block in query_blocks(queries, "query_id", block_bytes, max(1, KEPT_ROWS // k)):
        shared = spark.sparkContext.broadcast(block)
        kind = T.StructType([schema["query_id"]])
        part = images.select(F.col("image_id").cast("string"), "embedding").mapInArrow(local_best(shared, k, arrow_type(kind), one_each), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def arrow_type(kind: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind).field(0).type


def cut_at(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "image_id")
    return found.withColumn("cand_rank", F.row_number().over(w)).where(F.col("cand_rank") <= k)


def top_k(images: DataFrame, queries: DataFrame, k: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, image_id, cosine, cand_rank): of ``queries(query_id, vec)`` the ``k`` nearest of
    ``images(image_id, embedding)``, ties by image_id; fewer where there are fewer images.

    Zero vectors have cosine 0 with everything, null vectors and those of another length are no
    candidates; ``k`` under 1 is an error.
    """
    return cut_at(found_by(images, queries, k, block_bytes, False), k)


def region_max(regions: DataFrame, queries: DataFrame, k: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, image_id, cosine, cand_rank): images by their best region of
    ``regions(image_id, region_no, embedding)``. A task keeps the k best images by their best region
    there, so an image may have any number of regions, in any number of tasks."""
    best = found_by(regions, queries, k, block_bytes, True)
    return cut_at(best.groupBy("query_id", "image_id").agg(F.max("cosine").alias("cosine")), k)


def sample(images: DataFrame) -> tuple[np.ndarray, int] | None:
    """Unit vectors of a bounded sample of the most frequent length, and how many vectors there are."""
    n, width = images.where("embedding is not null").agg(F.count("*"), F.mode(F.size("embedding"))).first()
    if not n or not width:
        return None
    most = max(256, SAMPLE_BYTES // (8 * width))
    draw = F.pmod(F.xxhash64("image_id"), F.lit(1 << 30))
    some = images.where((F.size("embedding") == width) & (draw < min(1.0, 1.5 * most / n) * (1 << 30)))
    rows = some.orderBy(draw, "image_id").limit(most).select("embedding").toPandas()["embedding"]
    return (unit_rows(np.stack(rows)), n) if len(rows) else None


def cell_centres(x: np.ndarray, n: int) -> np.ndarray:
    """Unit centres of cells of about CELL of ``n`` vectors, by k-means on the sample ``x`` of them."""
    rng = np.random.default_rng(3)
    c = x[rng.permutation(len(x))[:int(max(1, min(n // CELL, len(x) // 8)))]]
    for _ in range(6):
        total = np.zeros_like(c)
        np.add.at(total, (x @ c.T).argmax(1), x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def facet_scores(images: DataFrame, facets: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(image_id, facet_no, score) for all images and ``facets(facet_no, vec)``."""
    spark, parts = images.sparkSession, []
    for block in query_blocks(facets, "facet_no", block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def score(batches, shared=shared):
            keys, q = shared.value
            step = max(1, AT_ONCE // len(q))
            for batch in batches:
                fits = fitting(batch.column(1), q.shape[1])
                if fits.any():
                    names, rows = batch.column(0).filter(pa.array(fits)), matrix(batch.column(1).filter(pa.array(fits)))
                    for i in range(0, len(rows), step):
                        s = cosines(q, rows[i:i + step]).T
                        of = np.repeat(np.arange(i, i + len(s)), len(keys))
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(of)).cast(pa.string()), pa.array(np.tile(np.array(keys, np.int64), len(s))), pa.array(s.ravel())],
                            ["image_id", "facet_no", "score"])

        parts.append(images.select(F.col("image_id").cast("string"), "embedding").mapInArrow(score, "image_id string, facet_no long, score double"))
    out = parts[0] if parts else spark.createDataFrame([], "image_id string, facet_no long, score double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
