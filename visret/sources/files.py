"""Readers of image folders, selection lists, annotation files, query lists and judgments."""

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visret.operators.catalog import only_images
from visret.schemas import ANNOTATIONS, JUDGMENTS, QUERIES
from visret.sources.json_arrays import elements
from visret.sources.lineage import cut
from visret.sources.listing import walked
from visret.sources.ranges import BLOCK, readable


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the images under ``root``, in folders of any depth, paths relative to it;
    contents are not read. Folders are listed by tasks; where only Spark can read the store, by Spark,
    which leaves out names that begin with a dot or an underscore. A missing root is an error."""
    return only_images(walked(spark, root) if readable(root) else by_spark(spark, root))


def by_spark(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of files as Spark lists them, on the driver. The list has the empty files too,
    which its scan leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toUri().getPath().rstrip("/") + "/"
    names = [(unquote(urlparse(f).path)[len(base):],) for f in files.inputFiles()]
    sizes = files.select(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "").alias("path"), "length")
    sizes = sizes.select(F.substring("path", len(base) + 1, 1 << 30).alias("path"), "length")
    every = spark.createDataFrame(names, "path string").join(sizes, "path", "left")
    return every.select("path", F.coalesce("length", F.lit(0)).alias("length"))


def selection_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a text file, numbered from 1 in its own order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "text")).select((F.col("n") + 1).alias("line_no"), "text")


def annotations(spark: SparkSession, path: str, *, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of a COCO-like JSON file of any size, with their positions.
    The file is read in blocks by many tasks."""
    every = cut(elements(spark, path, list(ANNOTATIONS), block=block))

    def part(name: str) -> DataFrame:
        own = every.where(F.col("name") == name).select("pos", F.from_json("value", ANNOTATIONS[name]).alias("r"))
        return own.select(F.col("pos").cast("int").alias("pos"), "r.*")

    return part("images"), part("categories").fillna("item", ["name"]), part("annotations").withColumnRenamed("pos", "ann_no")


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(path, multiLine=True).select(F.col("id").alias("query_id"), F.col("query").alias("text"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGMENTS).json(path, multiLine=True)
