"""Exact search that skips: images in cells with radii, and cells that can't hold a best image left out.

An image of a cell lies within the cell's radius, an angle, of its centre. By the triangle inequality
its angle to a query is at least the centre's less the radius, which bounds its cosine. A query first
looks into its nearest cells, as many as hold k images; the k-th best cosine found there is one that all
others must reach, so that the second look leaves out every cell whose bound is below it.
"""

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.operators.ann import result, together
from visret.operators.candidates import AT_ONCE, BLOCK_BYTES, KEPT_ROWS, Best, arrow_type, cell_centres, cut_at, fitting, matrix, query_blocks, sample, unit_rows

#: What a bound may be off by, in cosine: roundings of the products and of the radii.
SLACK = 1e-9


@dataclass
class Cells:
    """Centres, radii (angles) and images of cells. One more cell, the last, holds zero vectors and those
    of other lengths than the centres'; it is never left out."""

    centres: np.ndarray
    radii: np.ndarray
    images: np.ndarray

    def angles(self, q: np.ndarray) -> np.ndarray:
        """To each centre, queries x cells; zero queries are nearest to all."""
        return np.where(np.any(q, axis=1)[:, None], np.arccos(np.clip(q @ self.centres.T, -1, 1)), 0.0)

    def nearest(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query looks into first: the nearest that hold ``k`` images, and the last."""
        if q.shape[1] != self.centres.shape[1]:
            return np.r_[np.zeros(len(self.centres), bool), True] * np.ones((len(q), 1), bool)
        order = np.argsort(self.angles(q), axis=1, kind="stable")
        held = np.cumsum(self.images[order], axis=1)
        open_ = np.zeros((len(q), len(self.images)), bool)
        np.put_along_axis(open_, order, np.c_[np.ones(len(q), bool), held[:, :-1] < k], axis=1)
        open_[:, -1] = True
        return open_

    def others(self, q: np.ndarray, open_: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which further cells may hold an image whose cosine reaches each query's ``floor``."""
        if q.shape[1] != self.centres.shape[1]:
            return np.zeros_like(open_)
        bound = np.cos(np.maximum(0.0, self.angles(q) - self.radii[:-1]))
        bound[~np.any(q, axis=1)] = 0.0  # zero queries: all cosines are 0
        return np.c_[bound + SLACK >= floor[:, None], np.zeros(len(q), bool)] & ~open_


def placed(images: DataFrame, centres: np.ndarray) -> DataFrame:
    """(image_id, cell, angle, embedding) of all images with a vector."""
    shared = images.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        c = shared.value
        for batch in batches:
            fits = fitting(batch.column(1), c.shape[1])
            cell, angle = np.full(len(batch), len(c), np.int32), np.zeros(len(batch))
            if fits.any():
                x = unit_rows(matrix(batch.column(1).filter(pa.array(fits))))
                real = np.any(x, axis=1)
                x, at, step = x[real], np.flatnonzero(fits)[real], max(1, AT_ONCE // len(c))
                for i in range(0, len(x), step):
                    near = x[i:i + step] @ c.T
                    cell[at[i:i + step]] = near.argmax(1)
                    angle[at[i:i + step]] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(angle), batch.column(1)], ["image_id", "cell", "angle", "embedding"])

    schema = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), images.schema["embedding"]])
    return images.where("embedding is not null").select(F.col("image_id").cast("string"), "embedding").mapInArrow(place, schema)


def write(images: DataFrame, path: str) -> None:
    """Write ``images(image_id, embedding)`` sorted by cell, and the cells. Null vectors are left out; no
    vector at all is an error."""
    spark, some = images.sparkSession, sample(images)
    if some is None:
        raise ValueError("there are no vectors to index")
    centres = cell_centres(*some)
    placed(images, centres).repartitionByRange("cell", "image_id").sortWithinPartitions("cell", "image_id").write.mode("overwrite").parquet(f"{path}/vectors")
    per = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
    radii, n = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for r in per:
        radii[r["cell"]], n[r["cell"]] = r["radius"], r["n"]
    row = json.dumps({"centres": centres.tolist(), "radii": radii.tolist(), "images": n.tolist()})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cells")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    row = json.loads(spark.read.text(f"{path}/cells").first()[0])
    return spark.read.parquet(f"{path}/vectors"), Cells(*(np.array(row[c]) for c in ("centres", "radii", "images")))


def best_open(shared, k: int, kind: pa.DataType):
    """For mapInArrow over (image_id, cell, embedding): each task's ``k`` best of every query, among the
    cells that are open to it; no product is made for other cells."""
    def best(batches):
        keys, q, open_ = shared.value
        held = Best(q, k)
        for batch in batches:
            batch = batch.filter(pa.array(fitting(batch.column(2), q.shape[1])))
            if not len(batch):
                continue
            x, ids, cell = unit_rows(matrix(batch.column(2))), batch.column(0), batch.column(1).to_numpy()
            order = np.argsort(cell, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                held.look(ids.take(pa.array(own)), x[own], np.flatnonzero(open_[:, cell[own[0]]]))
        yield from held.found(keys, kind)

    return best


def search(vectors: DataFrame, cells: Cells, queries: DataFrame, k: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, image_id, cosine, cand_rank): the rows that ``candidates.top_k`` gives, from the stored
    ``vectors``. ``k`` under 1 is an error."""
    if k < 1:
        raise ValueError("k must be positive")
    spark, schema, parts = vectors.sparkSession, result(queries), []
    kind = arrow_type(T.StructType([schema["query_id"]]))

    def look(keys, q, open_):
        used = np.flatnonzero(open_.any(0)).tolist()
        some = vectors.where(F.col("cell").isin(used)) if len(used) < len(cells.images) // 2 else vectors
        return some.select("image_id", "cell", "embedding").mapInArrow(best_open(spark.sparkContext.broadcast((keys, q, open_)), k, kind), schema)

    for keys, q in query_blocks(queries, "query_id", block_bytes, max(1, KEPT_ROWS // k)):
        first = cells.nearest(q, k)
        near = cut_at(look(keys, q, first), k)
        floors = {r["query_id"]: r["f"] for r in near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("cosine").alias("f")).where(F.col("n") >= k).collect()}  # a row for each query of the block
        floor = np.array([floors.get(key, -2.0) for key in keys])
        parts += [near.drop("cand_rank"), look(keys, q, cells.others(q, first, floor))]
    return cut_at(together(parts, spark, schema), k)
