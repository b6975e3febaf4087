"""Incremental append to a table of contents, keyed by a hash of the content."""

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from visret.sources.lineage import exists, remove, touch

#: Where a stream's state is. Stores are many and small, so they take no disk before they need it.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def keyed(rows: DataFrame, content: str) -> DataFrame:
    return rows.withColumn("content_key", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))


def stored(spark: SparkSession, target: str) -> DataFrame | None:
    """The Parquet table ``target``; none where there is no such folder or it is empty. A table that
    a streaming file sink wrote is an error: its log hides what others append to it."""
    if exists(spark, f"{target}/_spark_metadata"):
        raise ValueError(f"{target} belongs to a streaming file sink, whose log hides files of others")
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def keys_of(table: DataFrame, content: str) -> DataFrame:
    """(content_key) of each content of a table, from its column of that name if it has one."""
    return (table if "content_key" in table.columns else keyed(table, content)).select("content_key").distinct()


def as_stored(rows: DataFrame, have: DataFrame | None) -> DataFrame:
    """``rows`` with the columns of the table that they are appended to."""
    return rows if have is None else rows.select([F.col(f.name).cast(f.dataType) for f in have.schema])


def append_new(spark: SparkSession, batch: DataFrame, content: str, target: str) -> None:
    """Append the rows of ``batch``, a table that is not a stream, whose content ``target`` doesn't
    have, one for each content."""
    new, have = keyed(batch, content).dropDuplicates(["content_key"]), stored(spark, target)
    if have is not None:
        new = new.join(keys_of(have, content), "content_key", "left_anti")
    as_stored(new, have).write.mode("append").parquet(target)


class FirstOfContent(StatefulProcessor):
    """Lets the first row of each content pass, unless the target had it or an earlier batch brought it.
    The state of a key is no more than that it was there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = next(rows, None)
        if first is not None and not self.known.exists():
            self.known.update((True,))
            yield first

    def close(self) -> None:
        pass


def append_stream(source: DataFrame, content: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now of a streaming ``source`` to the Parquet table ``target``, one row for
    each content that neither the target nor the stream has had, with its ``content_key`` (or with the
    columns that the target has).

    The keys that the target holds when the stream is first started are the initial state of the
    stream, and what it brings is added to that, by hash over tasks and on their disks: later batches
    read neither the target nor its keys. What others append to the target afterwards is not seen.
    Files are appended as by any writer, so readers find old and new ones. A batch leaves a mark
    beside the stream's checkpoint before it writes; one that is repeated after a failure finds the
    mark and leaves out contents that its first attempt wrote. ``checkpoint`` must be in a shared
    folder."""
    spark, marks = source.sparkSession, f"{checkpoint}-appending"
    have = stored(spark, target)
    known = spark.createDataFrame([], "content_key string") if have is None else keys_of(have, content)
    rows = keyed(source, content)

    def write(batch: DataFrame, number: int) -> None:
        own, there = f"{marks}/{number}", stored(batch.sparkSession, target)
        if exists(batch.sparkSession, own) and there is not None:
            batch = batch.join(keys_of(there, content), "content_key", "left_anti")
        touch(batch.sparkSession, own)
        as_stored(batch, there).write.mode("append").parquet(target)
        remove(batch.sparkSession, f"{marks}/{number - 1}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        new = rows.groupBy("content_key").transformWithState(FirstOfContent(), rows.schema, "Append", "None", known.groupBy("content_key"))
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
