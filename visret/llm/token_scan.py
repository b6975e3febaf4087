"""Token counts of the documents in flat, unindexed token files.

A flat file is nothing but two-byte token ids, each document closed by a separator id. It is read
in blocks of a fixed size, in any order and by any task. A vectorised search gives each block's
separators; where a block's first document began is found by a prefix scan over the blocks before
it: a running sum of tokens and a running maximum of separator places, first within chunks of
blocks and then over the chunks' totals, so that no task has more than a chunk's blocks or a file's
chunks.

Flat files are written by Spark's text writer: a row is a document's ids, and what the writer puts
behind a row is the separator, whose two bytes are a string as well.
"""

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import cut, drop, new_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: </s> of piece_bpe_32k.model, which no text has, as its ids are two bytes each, the low one first.
END, KIND = 2, "<u2"
BLOCK_TOKENS, CHUNK = 1 << 18, 4096
#: Texts that are encoded together.
TOGETHER = 64


def write_files(docs: DataFrame, folder: str, *, text: str = "text", path: str = PIECES, end: int = END) -> tuple[str, str]:
    """Write ``docs`` as flat files and return where they are, and where the files of names are:
    one of the same number for each flat file, with the doc_ids of its documents in order. Both
    come from one task, so they agree whatever the order in which ``docs`` is read. Null texts are
    empty documents. Ids that two bytes can't hold are an error."""
    def encode(batches):
        make = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            names, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data = []
            for i in range(0, len(rows), TOGETHER):
                for ids in make.encode([t or "" for t in rows[i:i + TOGETHER]], num_threads=1):
                    if ids and max(ids) > 0xFFFF or end in ids:
                        raise ValueError(f"an id is over two bytes, or the separator {end}")
                    data.append(np.array(ids, KIND).tobytes())
            names = [b"" if n is None else b"=" + str(n).encode().hex().encode() for n in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["ids"] * len(data) + ["names"] * len(names)), pa.array(data + names, pa.binary())], ["kind", "value"])

    rows = docs.select("doc_id", text).mapInArrow(encode, "kind string, value binary")
    # Sorted as the writer wants it, a file of each kind after the other, each in the order read.
    ordered = rows.withColumn("n", F.monotonically_increasing_id()).sortWithinPartitions("kind", "n")
    separator = int(end).to_bytes(2, "little").decode()
    (ordered.select("kind", F.col("value").cast("string")).write.partitionBy("kind").option("lineSep", separator)
     .option("compression", "none").option("maxRecordsPerFile", 0).text(folder))
    return f"{folder}/kind=ids", f"{folder}/kind=names"


def range_reader(path: str):
    """(file system, path in it) by which a worker reads ranges of ``path``."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:") if path.startswith(("file:", "/")) else path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def read_blocks(spark: SparkSession, path: str, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the flat files under ``path``; ``file`` is the path. Tasks read their
    blocks by byte ranges, so a file may be of any size. Where the store is one that only Spark can
    read, Spark's binary reader hands each file to a task whole (2 GB at most)."""
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(greatest(length, 1) - 1) div {size}")))
    try:
        range_reader(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return (files.select(F.col("path").alias("file"), "content", blocks.alias("block"))
                .selectExpr("file", "block", f"substring(content, cast(block * {size} + 1 as int), {size}) as data"))
    places = files.select(F.col("path").alias("file"), blocks.alias("block"))
    count = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    tasks = int(max(1, min(count, max(count // 16, 4 * spark.sparkContext.defaultParallelism))))

    def read(batches):
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inside = range_reader(file)
                with system.open_input_file(inside) as f:
                    data = f.read_at(min(size, f.size() - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return places.repartition(tasks, "file", "block").mapInArrow(read, "file string, block long, data binary")


def count_tokens(blocks: DataFrame, *, end: int = END) -> DataFrame:
    """One row per document of ``blocks(file, block, data)``: file, doc_no (from 0), start (ids of
    the file before it), n_tokens (without the separator) and ended. Ids after a file's last
    separator are a document that has not ended; a null or empty block has no ids; blocks are
    numbered from 0 without gaps.
    """
    found = T.StructType([T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])

    @F.arrow_udf(found)
    def search(data: pa.Array) -> pa.Array:
        ids = [np.frombuffer(b or b"", KIND) for b in data.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([len(x) for x in ids], pa.int64()), pa.array([np.flatnonzero(x == end) for x in ids], pa.list_(pa.int64()))], ["n", "ends"])

    each = cut(blocks.select("file", "block", F.expr(f"block div {CHUNK}").alias("chunk"), search.asNondeterministic()("data").alias("s"))
               .select("file", "block", "chunk", "s.n", "s.ends", F.size("s.ends").alias("k"), F.try_element_at("s.ends", F.lit(-1)).alias("last")))
    w = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    local = each.withColumn("before", zero(F.sum("n").over(w))).withColumn("docs", zero(F.sum("k").over(w)))
    local = local.withColumn("open", F.max(F.col("before") + F.col("last") + 1).over(w))
    chunks = local.groupBy("file", "chunk").agg(
        F.sum("n").alias("cn"), F.sum("k").alias("ck"), F.max(F.col("before") + F.col("last") + 1).alias("clast"))
    v = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("cbefore", zero(F.sum("cn").over(v))).withColumn("cdocs", zero(F.sum("ck").over(v)))
    chunks = chunks.withColumn("copen", zero(F.max(F.col("cbefore") + F.col("clast")).over(v)))
    placed = local.join(chunks, ["file", "chunk"]).select(
        "file", "ends", "k", (F.col("cbefore") + F.col("before")).alias("at"),
        (F.col("cdocs") + F.col("docs")).alias("first"), F.coalesce(F.col("cbefore") + F.col("open"), "copen").alias("open"))
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("at") + F.expr("try_element_at(ends, i)") + 1)
    rows = placed.select("*", F.posexplode("ends").alias("i", "place")).select(
        "file", (F.col("first") + F.col("i")).alias("doc_no"), begin.alias("start"),
        (F.col("at") + F.col("place") - begin).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = (chunks.groupBy("file").agg(F.sum("cn").alias("all"), F.sum("ck").alias("doc_no"), zero(F.max(F.col("cbefore") + F.col("clast"))).alias("start"))
            .where("all > start").select("file", "doc_no", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))
    return rows.unionByName(rest)


def named(counts: DataFrame, names: str, kind: T.DataType, *, end: int = END) -> DataFrame:
    """``counts`` of flat files with the number of the file for ``file`` and ``doc_id`` from the
    files of names, each of which has the base name of its flat file."""
    base = lambda c: F.regexp_extract(c, "[^/]+$", 0)
    number = lambda c: F.regexp_extract(c, r"part-(\d+)", 1).cast("long")
    separator = int(end).to_bytes(2, "little").decode()
    files = counts.sparkSession.read.format("binaryFile").load(names).select(base("path").alias("base"), F.col("content").cast("string").alias("all"))
    every = files.select("base", F.posexplode(F.split("all", separator)).alias("doc_no", "name"))
    doc = F.when(F.col("name") != "", F.decode(F.unhex(F.substring("name", 2, 1 << 30)), "UTF-8").cast(kind))
    every = every.select("base", F.col("doc_no").cast("long").alias("doc_no"), doc.alias("doc_id"))
    return counts.withColumn("base", base("file")).withColumn("file", number("file")).join(every, ["base", "doc_no"]).drop("base").select("file", "doc_no", *counts.columns[2:], "doc_id")


def of_documents(docs: DataFrame) -> DataFrame:
    """file, doc_no, start, n_tokens, ended and doc_id of every row of ``docs``, from flat files that
    are written for them and then scanned. Null and empty texts have no tokens; rows of repeated or
    null doc_ids are counted each; a document may reach over any number of blocks. Other columns,
    whatever their names, are not read."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession)
    ids, names = write_files(docs, folder)
    if docs.isEmpty():
        return spark.createDataFrame([], T.StructType([
            T.StructField("file", T.LongType()), T.StructField("doc_no", T.LongType()), T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ended", T.BooleanType()), docs.schema["doc_id"]]))
    out = cut(named(count_tokens(read_blocks(spark, ids)), names, docs.schema["doc_id"].dataType))
    drop(spark, folder)
    return out
