"""From image records to an index on disk: regions, vectors, store."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visret.functions.vectors import l2_normalized
from visret.operators import catalog, regions
from visret.operators.encode import backfilled
from visret.sources import store
from visret.sources.lineage import cut

#: crops(path, region_no, name, x0, y0, x1, y1) -> the same columns and ``embedding``
CropEncoder = Callable[[DataFrame], DataFrame]


def records(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, path, width, height, region_no, name, x0, y0, x1, y1) of every region of
    ``images(path, width, height)``, with annotated ``boxes`` of the files' names."""
    named = images.select(catalog.image_id(F.col("path")).alias("image_id"), "path", "width", "height")
    return named.join(regions.table(named, boxes), "image_id")


def build(images: DataFrame, boxes: DataFrame, encode: CropEncoder, path: str, model_id: str, cached: DataFrame | None = None) -> None:
    """Write the index of ``images(path, width, height)``: every region is encoded once (those in
    ``cached(path, model_id, embedding)``, keyed by path#region_no, are not), vectors are normalised,
    and region 0, the whole image, is the image's own vector. No images are an error."""
    every = records(images, boxes).withColumn("crop", F.concat_ws("#", "path", F.col("region_no").cast("string")))

    def coded(crops: DataFrame) -> DataFrame:
        wanted = every.join(crops.select(F.col("path").alias("crop")), "crop").select("path", "region_no", "name", "x0", "y0", "x1", "y1")
        return encode(wanted).select(F.concat_ws("#", "path", F.col("region_no").cast("string")).alias("path"), "embedding")

    crops = every.select(F.col("crop").alias("path"))
    vectors = coded(crops) if cached is None else backfilled(crops, cached, model_id, coded)
    rows = cut(every.join(vectors.select(F.col("path").alias("crop"), l2_normalized(F.col("embedding")).alias("embedding")), "crop").drop("crop"))
    whole = rows.where("region_no = 0").select("image_id", "path", "width", "height", "embedding")
    store.write(whole, rows.select("image_id", "region_no", "name", "embedding"), path, model_id)
