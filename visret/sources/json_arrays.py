"""The arrays of a top-level JSON object of any size, element by element, read by many tasks.

A file is cut into byte blocks. Whether a byte lies in a string, and how deep, depends on all before
it, but a block's effect on that is small: for each of the states it may begin in, the state it ends in
and the change of depth. Those are found for all blocks at once, a prefix scan over them gives every
block the state that it really begins in, and then each block finds the elements of the arrays in it.
An element that reaches over blocks is put together from its pieces.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visret.sources.ranges import BLOCK, blocks_of

QUOTE, BACKSLASH = ord('"'), ord("\\")
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]] = 1
STEP[[ord("}"), ord("]")]] = -1
#: A key and its colon at the end of what stands before an array.
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
#: Bytes before an array in which its key is looked for.
LOOK = 4096


def quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that no backslash escapes, and whether the byte after the block is escaped.
    ``escaped`` tells whether its first byte is. Backslashes stand in strings only."""
    slash = data == BACKSLASH
    at = np.flatnonzero(data == QUOTE)
    plain = np.flatnonzero(~slash)
    # Backslashes in a row before a place: all since the last other byte.
    last = np.searchsorted(plain, at) - 1
    run = np.where(last >= 0, at - 1 - plain[np.maximum(last, 0)], at + escaped) if len(plain) else at + escaped
    end = len(data) - 1 - plain[-1] if len(plain) else len(data) + escaped
    return at[run % 2 == 0], bool(end % 2)


def outside(n: int, at: np.ndarray, inside: bool) -> np.ndarray:
    """Which of ``n`` bytes are in no string, given its quotes and whether one is open at the start."""
    flips = np.zeros(n, np.int64)
    flips[at] = 1
    return (np.cumsum(flips) + inside) % 2 == 0


def summaries(batches):
    """For mapInArrow over (block, data): for each state a block may begin in, (whether its first byte is
    escaped, whether it is in a string), the state that it ends in and the change of depth."""
    for batch in batches:
        rows = []
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(raw, np.uint8)
            for escaped in (False, True):
                at, after = quotes(data, escaped)
                for inside in (False, True):
                    depth = int(STEP[data][outside(len(data), at, inside)].sum())
                    rows.append((block, 2 * escaped + inside, 2 * after + (inside + len(at)) % 2, depth))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["block", "begins", "ends", "depth"])


@dataclass
class Scan:
    """Where each block begins: its state and depth; and, once known, the number of the array that is
    open there (-1: none yet) and how many elements of it began before."""

    state: np.ndarray
    depth: np.ndarray
    array: np.ndarray
    count: np.ndarray


def scanned(blocks: DataFrame) -> Scan:
    """The prefix scan over all blocks, some numbers each. What isn't one JSON object is an error."""
    found = blocks.mapInArrow(summaries, "block long, begins long, ends long, depth long").toArrow().sort_by([("block", "ascending"), ("begins", "ascending")])
    n = len(found) // 4
    ends, change = (found[c].to_numpy().reshape(n, 4) for c in ("ends", "depth"))
    state, depth, s, d = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
    for b in range(n):
        state[b], depth[b] = s, d
        s, d = int(ends[b, s]), d + int(change[b, s])
    if n and (s % 2 or d):
        raise ValueError("the file is not one JSON object")
    return Scan(state, depth, np.full(n, -1), np.zeros(n, np.int64))


def marks(data: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where arrays and objects right in the top-level object begin, where what is nested right in
    those begins, and where that ends (excluded)."""
    at, _ = quotes(data, state >= 2)
    step = np.where(outside(len(data), at, bool(state % 2)), STEP[data], 0)
    deep = depth + np.cumsum(step)
    opens, closes = step > 0, step < 0
    return np.flatnonzero(opens & (deep == 2)), np.flatnonzero(opens & (deep == 3)), np.flatnonzero(closes & (deep == 2)) + 1


def counted(shared):
    """For mapInArrow over (block, data, before): a row for each array or object of the top level that begins
    in the block, with its key (an array's only) and the elements in it up to the next or the block's end;
    and one, without a key, for the elements before the first of them."""
    def count(batches):
        scan = shared.value
        for batch in batches:
            for block, raw, before in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                data = np.frombuffer(raw, np.uint8)
                opens, begins, _ = marks(data, int(scan.state[block]), int(scan.depth[block]))
                keys = [raw[o] == ord("[") and KEY.search((before or b"") + raw[:o] if o < LOOK else raw[o - LOOK:o]) for o in opens.tolist()]
                n = np.diff(np.r_[0, np.searchsorted(begins, opens), len(begins)])
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), pa.array([-1, *opens.tolist()], pa.int64()),
                                                  pa.array([None, *[k[1] if k else None for k in keys]], pa.binary()), pa.array(n)], ["block", "at", "key", "n"])

    return count


def pieces(shared):
    """For mapInArrow over (block, data): the elements, or the pieces of those that reach over blocks."""
    def cut_out(batches):
        scan, array_of, wanted = shared.value
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(raw, np.uint8)
                opens, begins, ends = marks(data, int(scan.state[block]), int(scan.depth[block]))
                array, count = int(scan.array[block]), int(scan.count[block])
                own = np.searchsorted(opens, begins, side="right")
                numbers = np.r_[array, [array_of[block, o] for o in opens.tolist()]][own].astype(np.int64) if len(begins) else np.zeros(0, np.int64)
                base = np.r_[count, np.zeros(len(opens), np.int64)]
                first = np.r_[0, np.searchsorted(begins, opens)]
                pos = base[own] + np.arange(len(begins)) - first[own] if len(begins) else np.zeros(0, np.int64)
                if scan.depth[block] >= 3:  # what an earlier block began
                    begins, numbers, pos = np.r_[0, begins], np.r_[array, numbers], np.r_[count - 1, pos]
                stop = np.r_[ends, [len(raw)] * (len(begins) - len(ends))].astype(np.int64)
                whole = np.arange(len(begins)) < len(ends)
                whole[:int(scan.depth[block] >= 3)] = False
                keep = np.flatnonzero(np.isin(numbers, wanted))
                yield pa.RecordBatch.from_arrays([
                    pa.array(numbers[keep]), pa.array(pos[keep]), pa.array([block] * len(keep), pa.int64()), pa.array(whole[keep]),
                    pa.array([raw[begins[i]:stop[i]] for i in keep.tolist()], pa.binary())], ["array", "pos", "block", "whole", "value"])

    return cut_out


def elements(spark: SparkSession, path: str, names: list[str], *, block: int = BLOCK) -> DataFrame:
    """(name, pos, value): the elements, as JSON text, of the arrays of these names in the JSON object that
    the file ``path`` holds, each with its place in its array. Elements must be objects or arrays; of
    arrays of one name the last holds; a name that is missing has no elements. A name must stand within
    LOOK bytes, and a block, before its array, and is compared as it is written there."""
    blocks = blocks_of(spark, path, block)
    scan = scanned(blocks)
    shared = spark.sparkContext.broadcast(scan)
    # A key may lie in the block before its array's.
    tails = blocks.select((F.col("block") + 1).alias("block"), F.expr(f"substring(data, greatest(1, length(data) - {LOOK - 1}), {LOOK})").alias("before"))
    found = blocks.join(tails, "block", "left").select("block", "data", "before").mapInArrow(counted(shared), "block long, at long, key binary, n long")
    rows = sorted(found.collect())  # a row for each block and for each array
    array_of, last, held, keys = {}, -1, 0, []
    for r in rows:
        if r["at"] < 0:
            scan.array[r["block"]], scan.count[r["block"]] = last, held
            held += r["n"]
        else:
            last, held = len(keys), r["n"]
            array_of[r["block"], r["at"]] = last
            keys.append(None if r["key"] is None else bytes(r["key"]).decode())
    wanted = {k: i for i, k in enumerate(keys) if k in names}  # of arrays of one name the last
    shared = spark.sparkContext.broadcast((scan, array_of, np.array(sorted(wanted.values()), np.int64)))
    parts = blocks.mapInArrow(pieces(shared), "array long, pos long, block long, whole boolean, value binary")
    split = parts.where("not whole").groupBy("array", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"))
    split = split.select("array", "pos", F.aggregate("p", F.lit(b""), lambda s, p: F.concat(s, p["value"])).alias("value"))
    every = parts.where("whole").select("array", "pos", "value").unionByName(split)
    name = F.try_element_at(F.create_map(*[F.lit(x) for k, i in wanted.items() for x in (i, k)]), F.col("array").cast("int")) if wanted else F.lit(None).cast("string")
    return every.select(name.alias("name"), "pos", F.col("value").cast("string").alias("value"))
