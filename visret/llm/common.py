"""What several operators of this subpackage share."""

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, one of our own if
    all runs on this machine, as in tests; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="visret-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A name for a folder in the shared one, which nothing has yet."""
    return f"{shared_folder(spark)}/visret-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that was made by ``new_folder``'s name."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Every byte to itself in lower case if it is an ASCII digit or letter or above 0x7F, else to a
#: space: the words are then the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
#: Lower-cases A-Z and leaves all else; bytes.split() then cuts at [\x20\x09-\x0D].
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def texts(array) -> Iterator[bytes]:
    """UTF-8 bytes of an Arrow string array, one text at a time; null as empty."""
    import pyarrow as pa

    return (x.as_py() or b"" for x in array.cast(pa.large_binary()))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each of the runs of the given lengths begins, and the end of the last."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first..first+count: which range each element belongs to, and the elements."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(starts_of(count)[:-1], count) + first[which]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``: the smallest id that links reach.

    Large-star and small-star rounds (Kiveris et al. 2014): in each, every id hands its
    neighbours to the smallest among them, by joins on minima that are aggregated map-side, until
    every edge points at a root. The edges never grow in number by more than one per id, and
    neither edges nor components come to the driver, only a count and a checksum per round.
    Edges are kept as (larger, smaller) and each end is looked up in that order, so a round
    has few stages and no table of both orders: the driver keeps record of every task.
    Empty edges give an empty result.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        # Large star: the smallest neighbour of v, or v itself where it has no smaller one.
        low = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        e = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("pair")
        e = cut(e.join(low, "u").select(pairs).select("pair.u", F.col("pair.m").alias("v"))
                .where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
