"""The index on disk: images, region vectors and a manifest."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visret.schemas import LAYOUT, MANIFEST
from visret.sources.lineage import exists

STRATEGY, METRIC, VERSION = "heuristic+annotations", "cosine", 1
TABLES = ("images", "regions")


def named(path: str, table: str) -> str:
    """The session's name of a table of the index at ``path``."""
    return f"visret_{hashlib.sha1(path.encode()).hexdigest()[:16]}_{table}"


def write(images: DataFrame, regions: DataFrame, path: str, model_id: str, buckets: int | None = None) -> None:
    """Write ``images(image_id, path, width, height, embedding)`` and ``regions(image_id,
    region_no, name, embedding)``, both in the same buckets of image_id (as many as the session's
    shuffle has partitions, if not said) and sorted by it, so that later joins on it move neither; an
    empty index is an error."""
    spark = images.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table, df in zip(TABLES, (images, regions), strict=True):
        spark.sql(f"DROP TABLE IF EXISTS {named(path, table)}")
        # Dealt as the buckets are, so that a task writes one bucket and a bucket is one file.
        (df.repartition(buckets, "image_id").write.mode("overwrite").bucketBy(buckets, "image_id").sortBy("image_id")
         .option("path", f"{path}/{table}").saveAsTable(named(path, table)))
    i = spark.table(named(path, "images")).agg(F.count("*").alias("image_count"), F.max(F.size("embedding")).alias("dimension")).first()
    if not i["image_count"]:
        raise ValueError("there are no images to index")
    most = spark.table(named(path, "regions")).groupBy("image_id").count().agg(F.max("count")).first()[0]
    row = (VERSION, model_id, i["dimension"], i["image_count"], most or 0, STRATEGY, METRIC)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    spark.createDataFrame([(buckets,)], LAYOUT).coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def bucketed(spark: SparkSession, path: str) -> list[DataFrame]:
    """Images and regions as tables of the session that know their buckets; an index without a layout has
    none."""
    if not exists(spark, f"{path}/layout"):
        return [spark.read.parquet(f"{path}/{table}") for table in TABLES]
    buckets = spark.read.schema(LAYOUT).json(f"{path}/layout").first()["buckets"]
    for table in TABLES:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{table}").schema)
        spark.sql(f"DROP TABLE IF EXISTS {named(path, table)}")
        spark.sql(f"CREATE TABLE {named(path, table)} ({columns}) USING parquet CLUSTERED BY (image_id) SORTED BY (image_id) INTO {buckets} BUCKETS LOCATION '{path}/{table}'")
    return [spark.table(named(path, table)) for table in TABLES]


def integrity(images: DataFrame, regions: DataFrame) -> DataFrame:
    """One row of what an index must agree on with its manifest."""
    a = images.agg(F.count("*").alias("images"), F.count_distinct("image_id").alias("distinct_images"),
                   F.min(F.size("embedding")).alias("min_dimension"), F.max(F.size("embedding")).alias("max_dimension"))
    r = regions.groupBy("image_id").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    b = r.agg(F.sum("n").alias("regions"), F.max("n").alias("max_regions"), F.min("lo").alias("min_region_dimension"), F.max("hi").alias("max_region_dimension"))
    orphans = r.join(images.select("image_id"), "image_id", "left_anti").agg(F.count("*").alias("orphan_images"))
    return a.crossJoin(b).crossJoin(orphans)  # a row each


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def other_models(vectors: DataFrame, model_id: str) -> DataFrame:
    """Rows of ``vectors(model_id, ...)`` that another model made, or none that is known: they can't
    be compared with an index of ``model_id``."""
    return vectors.where(~F.col("model_id").eqNullSafe(model_id))


def load(spark: SparkSession, path: str, model_id: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Images, regions and manifest; an error if they disagree or the model is another."""
    m = manifest(spark, path).first().asDict()
    if model_id is not None and m["model_id"] != model_id:
        raise ValueError(f"the index was made by {m['model_id']!r}, the query vectors by {model_id!r}")
    images, regions = bucketed(spark, path)
    got = integrity(images, regions).first()
    dimensions = {got[f"{m_}_dimension"] for m_ in ("min", "max", "min_region", "max_region")} - {None}
    if (got["images"], got["distinct_images"], got["max_regions"] or 0, got["orphan_images"]) != (m["image_count"], m["image_count"], m["max_regions"], 0) or dimensions != {m["dimension"]}:
        raise ValueError("vectors and manifest disagree")
    return images, regions, m


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files of the index."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.sum("length")).first()[0] or 0


def write_results(results: DataFrame, path: str, combined: bool = False) -> None:
    """Nested results as JSON, a folder per query; or, ``combined``, one file of all of them."""
    if combined:
        results.orderBy("query_id").coalesce(1).write.mode("overwrite").json(path)
    else:
        results.write.mode("overwrite").partitionBy("query_id").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_selection(picks: DataFrame, path: str) -> None:
    """``picks(pick_no, path)`` as one text file in the order of picks."""
    picks.orderBy("pick_no").select("path").coalesce(1).write.mode("overwrite").text(path)
