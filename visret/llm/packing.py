"""Packing of examples into sequences by vector bin packing.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. It is filled by the
dot-product heuristic: of the waiting examples that fit, the one whose demand has the largest dot
product with what is left of the sequence, each dimension divided by its limit and weighted by its
mean demand; of equal ones the one that waits at the lowest place. Tasks pack what they read, from a pool of bounded size, so nothing is shuffled;
what a task reads is fixed by its input split, so a lost task packs the same again.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import texts
from visret.llm.tokens import WORDS, tokenizer

MAX_TOKENS, MAX_SEGMENTS, END = 4096, 512, 2
#: Waiting examples at which a task begins to close sequences, and down to which it does.
POOL, REST = 1024, 512


class Bin:
    """The pool of one task and what it makes of it. An item is [tokens, loss, key]."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, float)
        self.demand = np.zeros((0, 3))
        self.items: list = []

    def add(self, items: list, demand: list) -> None:
        self.items += items
        self.demand = np.concatenate([self.demand, np.array(demand, float).reshape(-1, 3)])

    def take(self, i: int):
        """The item leaves the pool; the last one takes its place."""
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i], self.demand[i] = last, self.demand[-1]
        self.demand = self.demand[:-1]
        return item

    def best(self, left: np.ndarray, must_fit: bool) -> int | None:
        scaled = self.demand / self.limits
        value = scaled @ (left / self.limits * np.maximum(scaled.mean(0), 1e-9))
        if must_fit:
            value = np.where((self.demand <= left).all(1), value, -1.0)
        i = int(np.argmax(value))
        return i if value[i] >= 0 else None


def fill_whole(pool: Bin):
    """The items of the next sequence; none of them is cut."""
    left, inside = pool.limits.copy(), []
    while pool.items and (i := pool.best(left, True)) is not None:
        left = left - pool.demand[i]
        inside.append(pool.take(i))
    return inside


def fill_cut(pool: Bin):
    """The pieces (item, start, length) of the next sequence, of items (key, start, end) that may
    be cut and whose tokens all bear loss. Its length is the limit or else a power of two."""
    left, inside = pool.limits.copy(), []
    while pool.items and left.min() >= 1:
        i = pool.best(left, True)
        if i is None:  # none fits whole: cut the best one to what is left
            i = pool.best(left, False)
            room = int(min(left[0], left[2]))
            key, start, end = pool.items[i]
            pool.items[i] = (key, start + room, end)
            pool.demand[i] -= (room, 0, room)
            inside.append((key, start, start + room))
            left = left - (room, 1, room)
        else:
            left = left - pool.demand[i]
            inside.append(pool.take(i))
    total = sum(e - s for _, s, e in inside)
    if total < pool.limits[0]:
        over = total - (1 << total.bit_length() - 1)
        while over:  # what is beyond the power of two waits for the next sequence
            key, start, end = inside.pop()
            back = min(over, end - start)
            over -= back
            pool.add([(key, end - back, end)], [(back, 1, back)])
            if start < end - back:
                inside.append((key, start, end - back))
    return inside


def pack_examples(examples: DataFrame, *, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                  max_loss: int = MAX_TOKENS) -> DataFrame:
    """Whole examples ``(id, n_tokens, n_loss)`` -> id, n_tokens, n_loss, sequence_id, offset.

    An example that no empty sequence can hold, or whose numbers are null or negative, gets a null
    sequence_id and offset. Repeated ids are packed as often as they stand.
    """
    limits = (max_tokens, max_segments, max_loss)
    schema = T.StructType([*examples.select("id", "n_tokens", "n_loss").schema.fields,
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches):
        pool, at = Bin(limits), TaskContext.get().partitionId() << 33
        names = [f.name for f in schema]

        def closed(rest):
            nonlocal at
            out = []
            while len(pool.items) > rest:
                offset = 0
                for item in fill_whole(pool):
                    out.append((*item, at, offset))
                    offset += item[1]
                at += 1
            return out

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        kinds = None
        for batch in batches:
            kinds = [*batch.schema.types, pa.int64(), pa.int64()]
            rows = []
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                need = (item[1], 1, item[2])
                if None in need or min(need) < 0 or any(n > m for n, m in zip(need, limits, strict=True)):
                    rows.append((*item, None, None))
                    continue
                pool.add([item], [need])
                if len(pool.items) >= POOL:
                    rows += closed(REST)
            yield batch_of(rows)
        if kinds:
            yield batch_of(closed(0))

    return examples.select("id", "n_tokens", "n_loss").mapInArrow(pack, schema)


def conversation_sizes(turns: DataFrame, *, path: str = WORDS) -> DataFrame:
    """(id, n_tokens, n_loss) of each conv_id of ``turns(conv_id, role, text)``: every turn is its
    text's ids and an end, and those of the assistant bear loss. Null texts are an end alone, other
    and null roles bear no loss, turns that stand twice count twice, turns of a null conv_id are one
    conversation. Turns are counted before the shuffle, so a conversation may have any number."""
    @F.arrow_udf(T.LongType())
    def count(text: pa.Array) -> pa.Array:
        return pa.array([len(ids) // 4 + 1 for ids in tokenizer(path).ids(texts(text))], pa.int64())

    each = turns.select(F.col("conv_id").alias("id"), "role", count.asNondeterministic()(F.col("text")).alias("n"))
    return each.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("n_loss"))


def pack_texts(docs: DataFrame, *, text: str = "text", path: str = WORDS, end: int = END,
               max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, the ids as little-endian unsigned 32-bit bytes.

    A document is its text's ids and ``end``; a null or empty text is ``end`` alone. All its
    tokens bear loss, so that limit is that of tokens. Documents longer than a sequence and those
    that fill one up are cut; a sequence is as long as ``max_tokens`` or a power of two, so none
    is padded. Repeated rows are packed as often as they stand, null doc_ids stay null.
    """
    assert max_tokens & max_tokens - 1 == 0, "max_tokens must be a power of two"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    long = [T.StructField(n, T.LongType()) for n in names[1:7]]
    schema = T.StructType([docs.select("doc_id").schema[0], *long] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def pack(batches):
        pool, at = Bin((max_tokens, max_segments, max_tokens)), TaskContext.get().partitionId() << 33
        make, last, kind = tokenizer(path), end.to_bytes(4, "little"), None

        def rows_of(pieces):
            nonlocal at
            offset = 0
            for (doc, ids), start, stop in pieces:
                part = ids[4 * start:4 * stop]
                yield (doc, start, stop - start, zlib.crc32(part), len(ids) // 4, at, offset) + (part,) * with_ids
                offset += stop - start
            at += 1

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [kind, *[pa.int64()] * 6] + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind, rows = batch.column(0).type, []
            for doc, ids in zip(batch.column(0).to_pylist(), make.ids(texts(batch.column(1))), strict=True):
                ids += last
                n, whole = len(ids) // 4, len(ids) // 4 // max_tokens * max_tokens
                for start in range(0, whole, max_tokens):
                    rows += rows_of([((doc, ids), start, start + max_tokens)])
                if n > whole:
                    pool.add([((doc, ids), whole, n)], [(n - whole, 1, n - whole)])
                while len(pool.items) >= POOL:
                    while len(pool.items) > REST:
                        rows += rows_of(fill_cut(pool))
                if len(rows) > 10_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)
        rows = []
        while pool.items:
            rows += rows_of(fill_cut(pool))
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", text).mapInArrow(pack, schema)


def digest(docs: DataFrame, **options) -> DataFrame:
    return pack_texts(docs, with_ids=False, **options)
