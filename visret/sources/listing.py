"""Files under a folder, listed by tasks."""

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from visret.sources.lineage import cut
from visret.sources.ranges import opened

#: Folders that a task lists, and folders within folders at most.
FOLDERS, DEEP = 64, 10_000


def listed(root: str):
    """For mapInArrow over (path), folders relative to ``root``: (path, length, folder) of what is in
    each. Links to folders are not followed."""
    def look(batches):
        files, base = opened(root)
        base = base.rstrip("/") or "/"
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{base}/{path}" if path else base))
                found = [f for f in found if f.type == fs.FileType.File or f.type == fs.FileType.Directory and not (isinstance(files, fs.LocalFileSystem) and os.path.islink(f.path))]
                names = [f"{path}/{f.base_name}" if path else f.base_name for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f.size or 0 for f in found], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())],
                                                 ["path", "length", "folder"])

    return look


def walked(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under ``root``, paths relative to it. In each round tasks list the
    folders that the round before found; the driver learns how many those are, not their names. A missing
    root is an error."""
    files, base = opened(root)
    if files.get_file_info(base.rstrip("/") or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    folders, n, out = spark.createDataFrame([("",)], "path string"), 1, None
    for _ in range(DEEP):
        found = cut(folders.repartition(max(1, min(n, max(n // FOLDERS, spark.sparkContext.defaultParallelism)))).mapInArrow(listed(root), "path string, length long, folder boolean"))
        own = found.where("not folder").select("path", "length")
        out = own if out is None else out.unionByName(own)
        folders = found.where("folder").select("path")
        n = folders.count()
        if not n:
            return out
    raise RuntimeError(f"folders are nested more than {DEEP} deep")
