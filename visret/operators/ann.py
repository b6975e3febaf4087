"""Approximate search over a stored index: an inverted file of product-quantised codes.

Images are dealt to the nearest of many cells, and a vector is kept as one byte for each few of its
dimensions, the number of the nearest of 256 centres there. A query scores the codes of its nearest
cells by sums of looked-up products, and the best of these are rescored by their whole vectors. How
many cells and how many rescored images it takes is measured once, when the index is written, and
kept in its manifest; later runs only load it.
"""

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.operators.candidates import AT_ONCE, BEST_ROWS, arrow_type, cell_centres, cut_at, fitting, matrix, query_blocks, sample, top_k, unit_rows
from visret.operators.ordering import BEST, kept
from visret.sources.lineage import cut

#: Dimensions of a byte, centres of each, rounds of k-means, images that are searched for to measure
#: cells and depth, how many neighbours of each, and the share of neighbours that each must find.
DIMENSIONS, CENTRES, ROUNDS, MEASURED, NEIGHBOURS, FOUND = 4, 256, 8, 64, 10, 0.98
#: Bytes of lookup tables and of query vectors that are broadcast at a time.
TABLE_BYTES = 64 << 20
VERSION = 1


@dataclass
class Index:
    """What a search needs besides the codes: centres of cells and of bytes, numbers of cells to look
    into, and of images to rescore for each that is sought."""

    cells: np.ndarray
    books: list[np.ndarray]
    probes: int
    depth: float
    images: int

    @property
    def width(self) -> int:
        return self.cells.shape[1]

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A byte for each part of each unit vector."""
        near = [((b * b).sum(1) - 2 * p @ b.T).argmin(1) for p, b in zip(self.split(x), self.books, strict=True)]
        return np.stack(near, axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each part of each query with that part's centres: queries x parts x centres."""
        return np.stack([np.pad(p @ b.T, ((0, 0), (0, CENTRES - len(b)))) for p, b in zip(self.split(q), self.books, strict=True)], axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fitted(images: DataFrame) -> Index | None:
    """Cells and books from the bounded sample of the most frequent length of vectors."""
    if (some := sample(images)) is None:
        return None
    x, n = some
    cells = cell_centres(x, n)
    parts = np.array_split(np.arange(x.shape[1]), -(-x.shape[1] // DIMENSIONS))
    return Index(cells, [k_means(x[:, p], CENTRES) for p in parts], len(cells), 1.0, n)


def coded(images: DataFrame, index: Index) -> DataFrame:
    """(image_id, cell, code) of the images whose vectors fit."""
    shared = images.sparkSession.sparkContext.broadcast(index)

    def code(batches):
        i = shared.value
        for batch in batches:
            fits = pa.array(fitting(batch.column(1), i.width))
            if len(ids := batch.column(0).filter(fits)):
                x = unit_rows(matrix(batch.column(1).filter(fits)))
                codes = i.codes(x)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([ids, pa.array((x @ i.cells.T).argmax(1), pa.int32()), raw.cast(pa.binary())], ["image_id", "cell", "code"])

    return images.select(F.col("image_id").cast("string"), "embedding").mapInArrow(code, "image_id string, cell int, code binary")


def best_codes(shared, depth: int, kind: pa.DataType):
    """For mapInArrow over (image_id, cell, code): each task's ``depth`` best images of every query of
    the block, by their codes, among the query's cells."""
    def best(batches):
        keys, tables, open_ = shared.value
        held = None
        for batch in batches:
            cell = batch.column(1).to_numpy()
            wanted = np.flatnonzero(open_[:, cell].any(0))
            ids, codes = batch.column(0), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
            step = max(1, AT_ONCE // len(keys))
            for i in range(0, len(wanted), step):
                at = wanted[i:i + step]
                score = np.zeros((len(keys), len(at)), tables.dtype)
                for m in range(codes.shape[1]):
                    score += tables[:, m][:, codes[at, m]]
                score[~open_[:, cell[at]]] = -np.inf
                floor = np.full(len(keys), -np.inf)
                if held is not None:
                    have = np.bincount(held["key"].to_numpy(), minlength=len(keys))
                    floor[have == depth] = held["score"].to_numpy()[np.cumsum(have)[have == depth] - 1]
                if score.shape[1] > depth:
                    floor = np.maximum(floor, -np.partition(-score, depth - 1, axis=1)[:, depth - 1])
                a, b = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                new = pa.table({"key": pa.array(a, pa.int64()), "score": score[a, b].astype(float), "id": ids.take(pa.array(at[b])).cast(pa.string())}, schema=BEST)
                held = kept(new if held is None else pa.concat_tables([held, new]), depth)
        if held is not None:
            names = pa.array(keys, kind).take(pa.array(held["key"].to_numpy()))
            yield from pa.table({"query_id": names, "image_id": held["id"], "cosine": held["score"]}).to_batches(10_000)

    return best


def result(queries: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("image_id", T.StringType()), T.StructField("cosine", T.DoubleType())])


def together(parts: list[DataFrame], spark: SparkSession, schema: T.StructType) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shortlist(codes: DataFrame, index: Index, queries: DataFrame, depth: int, probes: int) -> DataFrame:
    """(query_id, image_id, cosine, cand_rank): for each query the ``depth`` best images by their codes
    in its ``probes`` nearest cells. Lookup tables are broadcast in blocks of a checked size."""
    spark, schema, parts = codes.sparkSession, result(queries), []
    kind = arrow_type(T.StructType([schema["query_id"]]))
    most = max(1, min(TABLE_BYTES // (4 * CENTRES * len(index.books)), BEST_ROWS // depth))
    for keys, q in query_blocks(queries, "query_id", TABLE_BYTES, most):
        if q.shape[1] != index.width:
            continue
        near = np.argsort(-(q @ index.cells.T), axis=1, kind="stable")[:, :probes]
        open_ = np.zeros((len(q), len(index.cells)), bool)
        np.put_along_axis(open_, near, True, axis=1)
        some = codes
        used = np.flatnonzero(open_.any(0))
        if len(used) < len(index.cells) // 2:  # the scan skips what lies in no query's cells
            some = codes.where(F.col("cell").isin(used.tolist()))
        shared = spark.sparkContext.broadcast((keys, index.tables(q).astype(np.float32), open_))
        parts.append(some.select("image_id", "cell", "code").mapInArrow(best_codes(shared, depth, kind), schema))
    return cut_at(together(parts, spark, schema), depth)


def rescored(found: DataFrame, images: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, image_id, cosine) of ``found(query_id, image_id)`` by whole vectors: found pairs go to
    where the images are, query vectors in broadcast blocks, and no vector is shuffled for it."""
    spark, schema, parts = images.sparkSession, result(queries), []
    kind = arrow_type(T.StructType([schema["query_id"]]))
    found = found.select("query_id", "image_id")
    blocks = query_blocks(queries, "query_id", TABLE_BYTES)
    for keys, q in blocks:
        own = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], T.StructType([schema["query_id"], T.StructField("place", T.IntegerType())])))
        asked = found.join(own, "query_id").groupBy("image_id").agg(F.collect_list("place").alias("places"))
        shared = spark.sparkContext.broadcast((keys, q))

        def score(batches, shared=shared):
            keys, q = shared.value
            for batch in batches:
                fits = pa.array(fitting(batch.column(1), q.shape[1]))
                batch = batch.filter(fits)
                if not len(batch):
                    continue
                x, places = unit_rows(matrix(batch.column(1))), batch.column(2)
                row, at = np.repeat(np.arange(len(batch)), np.asarray(places.value_lengths())), np.asarray(places.flatten())
                step = max(1, AT_ONCE // q.shape[1])
                dots = np.concatenate([np.einsum("ij,ij->i", x[row[i:i + step]], q[at[i:i + step]]) for i in range(0, len(row), step)] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind).take(pa.array(at)), batch.column(0).take(pa.array(row)), pa.array(np.round(dots, 12))], schema.names)

        parts.append(images.select(F.col("image_id").cast("string").alias("image_id"), "embedding").join(asked, "image_id").mapInArrow(score, schema))
    return together(parts, spark, schema)


def measured(codes: DataFrame, images: DataFrame, index: Index) -> tuple[int, float]:
    """Cells to look into, and images to rescore for each that is sought, with which FOUND of the true
    NEIGHBOURS of MEASURED images are found by each."""
    some = cut(images.where(F.size("embedding") == index.width).select(F.col("image_id").cast("string").alias("query_id"), F.col("embedding").alias("vec"))
               .orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED))
    true = cut(top_k(images, some, NEIGHBOURS + 1).where("query_id <> image_id").select("query_id", "image_id"))
    cells = {r["image_id"]: r["cell"] for r in codes.join(F.broadcast(true.select("image_id").distinct()), "image_id").select("image_id", "cell").collect()}
    vectors = {r["query_id"]: r["vec"] for r in some.collect()}
    pairs = [(r["query_id"], r["image_id"]) for r in true.collect() if r["image_id"] in cells]  # MEASURED x NEIGHBOURS at most
    if not pairs:
        return 1, 1.0
    near = np.argsort(-(unit_rows([vectors[q] for q, _ in pairs]) @ index.cells.T), axis=1, kind="stable")
    place = (near == np.array([cells[i] for _, i in pairs])[:, None]).argmax(1) + 1
    probes = int(np.quantile(place, FOUND, method="higher"))
    depth, have = 8 * NEIGHBOURS, codes.count()
    while True:  # ranks by codes, of more and more images until enough true neighbours are among them
        rank = shortlist(codes, index, some, min(depth, have), probes).join(F.broadcast(true), ["query_id", "image_id"]).select("cand_rank").collect()
        inside = int((place <= probes).sum())
        if depth >= have or len(rank) >= FOUND * inside:
            ranks = sorted(r["cand_rank"] for r in rank)
            at = min(len(ranks), max(1, int(np.ceil(FOUND * inside))))
            return probes, max(1.0, ranks[at - 1] / NEIGHBOURS) if ranks else 1.0
        depth *= 4


def write(images: DataFrame, path: str) -> None:
    """Write the approximate index of ``images(image_id, embedding)``: codes, sorted by cell, and a
    manifest with centres, cells to look into and depth. Null vectors and those of another than the
    most frequent length are left out; no vector at all is an error."""
    spark, index = images.sparkSession, fitted(images)
    if index is None:
        raise ValueError("there are no vectors to index")
    coded(images, index).repartitionByRange("cell", "image_id").sortWithinPartitions("cell", "image_id").write.mode("overwrite").parquet(f"{path}/codes")
    codes = spark.read.parquet(f"{path}/codes")
    index.probes, index.depth = measured(codes, images, index)
    row = {"version": VERSION, "images": codes.count(), "probes": index.probes, "depth": index.depth, "cells": index.cells.tolist(), "books": [b.tolist() for b in index.books]}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Index]:
    """Codes and index that ``write`` wrote; another version is an error."""
    row = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if row["version"] != VERSION:
        raise ValueError(f"the index is of version {row['version']}, not {VERSION}")
    return spark.read.parquet(f"{path}/codes"), Index(np.array(row["cells"]), [np.array(b) for b in row["books"]], row["probes"], row["depth"], row["images"])


def depth_for(index: Index, k: int) -> int:
    return max(1, min(index.images, int(np.ceil(index.depth * k))))


def search(codes: DataFrame, index: Index, images: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, image_id, cosine, cand_rank) as ``candidates.top_k`` gives them, for ``queries(query_id,
    vec)`` over the stored index of ``images``: cosines are exact, some of the k best may be missing.
    Queries of another length than the index's find nothing; ``k`` under 1 is an error."""
    if k < 1:
        raise ValueError("k must be positive")
    queries = cut(queries.select("query_id", "vec"))
    short = cut(shortlist(codes, index, queries, depth_for(index, k), index.probes))
    return cut_at(rescored(short, images, queries), k)
