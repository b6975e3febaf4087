"""Benchmark decontamination: which words of a document stand inside a benchmark window.

Prefix-filtered set join. A window of ``window`` item words is a set of word shingles that must
all occur, so by the prefix principle (overlap threshold = size) its rarest shingle alone has to
be joined. Rarity is the shingle's count over all documents. A document position that carries a
prefix shingle gives the only start that the window can have there (positional bound) and must
leave room for it (length bound); the words are then compared one by one (verification).

The index of windows is broadcast in blocks of a checked size; further blocks take further passes
over the documents, so a benchmark of any size gives whole results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import ALNUM, cut, expand, starts_of, texts

SHINGLE = 3
AT_ONCE = 512  # texts that a task holds as word numbers at a time
BITS = 21  # of a word number; three of them fill a key
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def keys_of(ids: np.ndarray, size: int) -> np.ndarray:
    """Of ``size`` consecutive word numbers at each place: one key, 0 if any is unknown."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, known = ids[:n].copy(), ids[:n] > 0
    for k in range(1, size):
        key = (key << BITS) | ids[k:k + n]
        known &= ids[k:k + n] > 0
    return np.where(known, key, 0)


class Windows:
    """One block of windows as arrays: ``ids`` (padded with -1), ``size`` and ``item`` of each."""

    def __init__(self, window: int):
        self.window, self.vocab, self.names = window, {}, []
        self.rows: list[tuple[int, list[int]]] = []
        self.bytes = 0

    def add(self, name: str, words: list[bytes]) -> None:
        ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
        self.names.append(name)
        for i in range(max(1, len(ids) - self.window + 1)):
            self.rows.append((len(self.names) - 1, ids[i:i + self.window]))
        # A word's entry, and its window's ids, size, item and shingles, each with key and place.
        self.bytes += len(words) * (130 + 8 * self.window + 16 + 32 * (self.window - SHINGLE + 1))

    def close(self) -> "Windows":
        self.item = np.array([r[0] for r in self.rows], np.int64)
        self.size = np.array([len(r[1]) for r in self.rows], np.int64)
        self.ids = np.full((len(self.rows), self.window), -1, np.int64)
        for i, (_, ids) in enumerate(self.rows):
            self.ids[i, :len(ids)] = ids
        del self.rows
        #: shingle size -> all shingle keys of windows that use that size, sorted
        self.all_keys = {}
        self.places = {}
        for s in range(1, min(SHINGLE, self.window) + 1):
            w = np.flatnonzero(np.minimum(self.size, SHINGLE) == s)
            n = self.size[w] - s + 1
            which, at = expand(np.zeros(len(w), np.int64), n)
            key = np.zeros(len(which), np.int64)
            for k in range(s):
                key = (key << BITS) | self.ids[w[which], at + k]
            self.places[s] = (w[which], at, key)
            self.all_keys[s] = np.unique(key)
        return self

    def index(self, counts: dict[int, np.ndarray]) -> None:
        """Keep of each window its rarest shingle (ties: the smaller key, then place)."""
        self.prefix = {}
        for s, (window, at, key) in self.places.items():
            rarity = counts[s][np.searchsorted(self.all_keys[s], key)]
            order = np.lexsort((at, key, rarity, window))
            first = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
            first = first[np.argsort(key[first], kind="stable")]
            k, start, n = np.unique(key[first], return_index=True, return_counts=True)
            self.prefix[s] = (k, start, n, window[first], at[first])
        del self.places

    def numbers(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a batch of texts, one after another, and where each text begins."""
        get, flat, counts = self.vocab.get, [], []
        for text in texts(array):
            words = text.translate(ALNUM).split()
            counts.append(len(words))
            flat.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), starts_of(np.array(counts, np.int64))

    def occurrences(self, ids: np.ndarray, starts: np.ndarray):
        """(text, start in ``ids``, window) of every verified occurrence."""
        out = []
        for s, (keys, first, n, window, at) in self.prefix.items():
            if not len(keys):
                continue
            here = keys_of(ids, s)
            places = np.flatnonzero(here)
            slot = np.searchsorted(keys, here[places])
            slot[slot == len(keys)] = 0
            hit = keys[slot] == here[places]
            places, slot = places[hit], slot[hit]
            which, post = expand(first[slot], n[slot])
            w, begin = window[post], places[which] - at[post]
            text = np.searchsorted(starts, places[which], side="right") - 1
            fits = (begin >= starts[text]) & (begin + self.size[w] <= starts[text + 1])
            w, begin, text = w[fits], begin[fits], text[fits]
            same = np.ones(len(w), bool)
            for k in range(self.window):
                inside = k < self.size[w]
                same &= ~inside | (ids[np.minimum(begin + k, len(ids) - 1)] == self.ids[w, k])
            out.append((text[same], begin[same], w[same]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def blocks(items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int) -> Iterator[Windows]:
    """The items' windows, in blocks that stay under ``block_bytes`` (one item at least)."""
    block = Windows(window)
    for row in items.select(F.col(item_id).cast("string"), item_text).toLocalIterator():
        words = (row[1] or "").encode().translate(ALNUM).split()
        if not words:
            continue
        if block.names and (block.bytes > block_bytes or len(block.vocab) + len(words) >= 1 << BITS):
            yield block.close()
            block = Windows(window)
        block.add(row[0] or "", words)
    if block.names:
        yield block.close()


def portions(array: pa.Array) -> Iterator[pa.Array]:
    return (array.slice(i, AT_ONCE) for i in range(0, len(array), AT_ONCE))


def shingle_counts(docs: DataFrame, text: str, block: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the block's windows stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        b = shared.value
        total = {s: np.zeros(len(k), np.int64) for s, k in b.all_keys.items()}
        for ids, starts in (b.numbers(part) for batch in batches for part in portions(batch.column(0))):
            for s, keys in b.all_keys.items():
                if len(keys):
                    here = keys_of(ids, s)
                    here = here[here > 0]
                    slot = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
                    total[s] += np.bincount(slot[keys[slot] == here], minlength=len(keys))
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), s, np.int64)), pa.array(at), pa.array(n[at])], ["s", "slot", "n"])

    rows = docs.select(text).mapInArrow(count, "s long, slot long, n long").groupBy("s", "slot").agg(F.sum("n").alias("n"))
    out = {s: np.zeros(len(k), np.int64) for s, k in block.all_keys.items()}
    for r in rows.toLocalIterator():  # no more rows than the block has shingles
        out[r["s"]][r["slot"]] = r["n"]
    return out


def matched(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = 10, block_bytes: int = 64 << 20,
            into: str = "found") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, spans (start, end of each run of hit words, words
    from 0, ends excluded) and items (ids as strings, distinct, sorted as strings).

    A null or wordless text has no words, spans or items. An item without words has no window, one
    of fewer than ``window`` words is one window. Repeated items count once by their id, a null id
    counts as the empty string. All other columns of ``docs`` stay as they are, whatever their
    names; without items every document is clean.
    """
    sc = docs.sparkSession.sparkContext
    state = None
    for block in blocks(items, item_id, item_text, window, block_bytes):
        block.index(shingle_counts(docs, text, block))
        shared = sc.broadcast(block)
        step = _finder(shared)
        if state is not None:
            docs = cut(docs)
        docs = docs.withColumn(into, step(F.col(text), F.col(into) if state is not None else F.lit(None).cast(FOUND)))
        state = shared
    if state is None:
        block = Windows(window).close()
        block.index({s: np.zeros(0, np.int64) for s in block.all_keys})
        docs = docs.withColumn(into, _finder(sc.broadcast(block))(F.col(text), F.lit(None).cast(FOUND)))
    return docs


def _finder(shared):
    def find_some(text: pa.Array, before: pa.Array) -> pa.Array:
        b = shared.value
        ids, starts = b.numbers(text)
        doc, begin, window = b.occurrences(ids, starts)
        end = begin + b.size[window]
        found = before.to_pylist() if before.null_count < len(before) else [None] * len(before)
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, end, -1)
        pairs = np.unique(np.stack([doc, b.item[window]]), axis=1)
        names: dict[int, set[str]] = {}
        for d, i in pairs.T.tolist():
            names.setdefault(d, set()).add(b.names[i])
        for d, f in enumerate(found):
            if f:
                names.setdefault(d, set()).update(f["items"])
                for x in f["spans"]:
                    mark[starts[d] + x["start"]] += 1
                    mark[starts[d] + x["end"]] -= 1
        hit = np.cumsum(mark[:-1]) > 0
        edge = np.zeros(len(ids), bool)
        edge[starts[:-1][starts[:-1] < len(ids)]] = True
        first = np.flatnonzero(hit & (edge | ~np.r_[False, hit[:-1]]))
        last = np.flatnonzero(hit & (np.r_[edge[1:], True] | ~np.r_[hit[1:], False])) + 1
        of = np.searchsorted(starts, first, side="right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(first - starts[of]), pa.array(last - starts[of])], ["start", "end"])
        per = starts_of(np.bincount(of, minlength=len(found)))
        return pa.StructArray.from_arrays([
            pa.array(np.diff(starts)),
            pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans),
            pa.array([sorted(names.get(d, ())) for d in range(len(found))], pa.list_(pa.string())),
        ], ["n_words", "spans", "items"])

    @F.arrow_udf(FOUND)
    def find(text: pa.Array, before: pa.Array) -> pa.Array:
        some = [find_some(a, b) for a, b in zip(portions(text), portions(before), strict=True)]
        return pa.concat_arrays(some) if some else find_some(text, before)

    return find.asNondeterministic()  # so that it runs once a row, however many columns use it


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document with the digest columns of its matches."""
    f = matched(docs.select("doc_id", "text"), items, **options)
    hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return f.select(
        "doc_id", F.col("found.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    into = "found"
    while into in docs.columns:
        into += "_"
    return matched(docs, items, into=into, **options).where(F.size(F.col(into)["spans"]) == 0).drop(into)
