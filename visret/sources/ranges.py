"""Byte ranges of one file, read by tasks."""

from pyarrow import ArrowInvalid, ArrowNotImplementedError, RecordBatch, array, binary, fs, int64
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block, and blocks of a task at most.
BLOCK, BLOCKS = 4 << 20, 16


def opened(path: str):
    """(file system, path in it) by which a task reads ``path``; an error where only Spark can."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:") if path.startswith(("file:", "/")) else path
    if uri.startswith("file://"):  # names may have any characters
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file://").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def readable(path: str) -> bool:
    """Whether tasks can read ``path`` themselves, without Spark."""
    try:
        opened(path)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


class Blocks(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class ByteBlocks(DataSource):
    """``spark.read.format("byte_blocks").option("block", n).load(path)``: (block, data) of a file, with
    blocks numbered from 0; an empty file has none."""

    @classmethod
    def name(cls) -> str:
        return "byte_blocks"

    def schema(self) -> str:
        return "block long, data binary"

    def reader(self, schema) -> "BlockReader":
        return BlockReader(self.options["path"], int(self.options.get("block", BLOCK)))


class BlockReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Blocks]:
        files, inside = opened(self.path)
        info = files.get_file_info(inside)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        n = -(-info.size // self.size)
        return [Blocks(i, min(BLOCKS, n - i)) for i in range(0, n, BLOCKS)] or [Blocks(0, 0)]

    def read(self, partition: Blocks):
        files, inside = opened(self.path)
        with files.open_input_file(inside) as f:
            whole = f.size()
            for b in range(partition.first, partition.first + partition.count):
                data = f.read_at(min(self.size, whole - b * self.size), b * self.size)
                yield RecordBatch.from_arrays([array([b], int64()), array([data], binary())], ["block", "data"])


def blocks_of(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    """(block, data) of a file. Where only Spark can read the store, its binary reader hands the file to
    one task whole (2 GB at most)."""
    if readable(path):
        spark.dataSource.register(ByteBlocks)
        return spark.read.format("byte_blocks").option("block", str(size)).load(path)
    whole = spark.read.format("binaryFile").load(path)
    numbers = f"explode(sequence(0L, (greatest(length, 1) - 1) div {size})) as block"
    return whole.selectExpr("content", numbers).selectExpr("block", f"substring(content, cast(block * {size} + 1 as int), {size}) as data")
