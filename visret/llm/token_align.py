"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Pointer jumping. Every token of either tokenizer points to the token that overlaps it and reaches
farthest to the right (a token of A that ends where a token of B ends points to itself, and that
token of B to it). Successors are then doubled, ``next = next[next]`` over all tokens of many texts
at once, until nothing moves: each token then points to the last token of its component, which
names its group. Tokens of a group are those between two byte offsets where both tokenizers end.

Texts are encoded stretch by stretch where that gives the ids of the whole: a single space between
two visible characters always begins a token of both tokenizers. Stretches are remembered.
"""

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from visret.llm.common import cut, drop, new_folder, starts_of
from visret.llm.tokens import PLAIN, Remembered, byte_names, packed

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Characters of a stretch that is remembered at most, and bytes of texts aligned at a time (one text
#: at least).
LONG, TOGETHER = 64, 1 << 20
#: Pairs of ids, 17 bytes each, whose counts are broadcast at a time; more take further passes.
PAIRS = 1 << 21

ALIGNED = T.StructType([*[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType()),
                        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def visible(c: str) -> bool:
    return c.isprintable() and c not in " ▁"


class Tokenizers:
    """A byte-level tokenizer file A and a sentencepiece model B."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        of = {c: i for i, c in byte_names().items()}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        how = json.loads(self.a.to_str())
        before, sample = how["pre_tokenizer"] or {}, "ﬁ a  bé ①"
        level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = level and not any("▁" in p.lstrip("▁") for p in pieces) and self.b.normalize(sample) == "▁" + sample.replace(" ", "▁")
        self.words = Remembered(self.word)
        # A's merges by tiktoken where ids are the order of merges, which is many times as fast.
        merges = [m.split(" ") if isinstance(m, str) else m for m in how["model"].get("merges", [])]
        self.quick = None
        if level and [names["".join(m)] for m in merges] == list(range(256, 256 + len(merges))) and how["normalizer"] is None:
            ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: What stands for a token in a text of groups: at 2 * id in the middle of its side, at 2 * id
        #: + 1 as its first.
        sides = ((self.bytes_a, b",", b";"), (self.bytes_b, b",", b"|"))
        self.written = [mark + str(i).encode() for side, *marks in sides for i in range(len(side)) for mark in marks]

    def stretch(self, s: str) -> bytes | None:
        """B's ids as little-endian unsigned 32-bit bytes; none where they don't spell space + s."""
        ids = self.b.encode(s, num_threads=1)
        return packed(ids) if b"".join(map(self.bytes_b.__getitem__, ids)) == (" " + s).encode() else None

    def word(self, s: str) -> bytes | None:
        return self.stretch(s) if 0 < len(s) <= LONG and visible(s[0]) and visible(s[-1]) else None

    def side_a(self, text: str, plain: bool) -> bytes:
        if plain and self.quick and PLAIN.fullmatch(text):
            return packed(self.quick.encode_ordinary(" " + text))
        return packed(self.a.encode(" " + text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both as little-endian unsigned 32-bit bytes, none where they don't spell the text."""
        if not text:
            return b"", b""
        parts = text.split(" ") if self.cuts else [text]
        got = list(map(self.words.__getitem__, parts)) if self.cuts else [None]
        if None in got:  # stretches that are not remembered, or where a space is not alone
            ends = [g is not None or bool(p) and visible(p[-1]) for p, g in zip(parts, got, strict=True)]
            begins = [g is not None or bool(p) and visible(p[0]) for p, g in zip(parts, got, strict=True)]
            cuts = [0, *[i for i in range(1, len(parts)) if ends[i - 1] and begins[i]], len(parts)]
            some = zip(cuts, cuts[1:], strict=False)
            parts, got = zip(*[(x := " ".join(parts[i:j]), self.stretch(x) if j > i + 1 or got[i] is None else got[i]) for i, j in some], strict=True)
            if None in got:
                return b"", b""
        plain = max(map(len, parts)) < LONG * LONG
        if len(text) <= TOGETHER:
            return self.side_a(text, plain), b"".join(got)
        out, some, size = [], [], 0
        for p in parts:
            if some and size + len(p) > TOGETHER:
                out.append(self.side_a(" ".join(some), plain))
                some, size = [], 0
            some.append(p)
            size += len(p) + 1
        return b"".join([*out, self.side_a(" ".join(some), plain)]), b"".join(got)


MADE: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    if (a, b) not in MADE:
        MADE[a, b] = Tokenizers(a, b)
    return MADE[a, b]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group, numbered from 0, of every token of two sequences that are given by the offsets
    where their tokens end and that end together; and the last token of each group in both."""
    n = len(ends_a)
    reach = np.searchsorted(ends_b, ends_a)
    successor = np.concatenate([np.where(ends_b[reach] == ends_a, np.arange(n), n + reach), np.searchsorted(ends_a, ends_b)])
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            break
        successor = further
    last = np.zeros(n, bool)
    last[successor] = True
    group = (np.cumsum(last) - 1)[successor]
    last_a = np.flatnonzero(last)
    return group[:n], group[n:], last_a, np.searchsorted(ends_b, ends_a[last_a])


def together(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t or "") > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    yield some


def aligned(texts: list[str | None], tok: Tokenizers) -> pa.Array:
    """A row of ALIGNED for every text; pairs are a << 32 | b, each once with its times."""
    raw = [tok.ids(t) for t in texts]
    sides = [[r[k] for r in raw] for k in range(2)]
    a, b = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in sides)
    n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in sides)
    group_a, group_b, last_a, last_b = groups_of(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]))
    first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
    # In order of groups, A before B: before a token of A stand the tokens of B of earlier groups.
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.flatnonzero(first_b)[group_a]] = 2 * a + first_a
    order[np.arange(len(b)) + last_a[group_b] + 1] = 2 * (len(tok.bytes_a) + b) + first_b
    doc = np.searchsorted(starts_of(n_a)[1:], last_a, side="right")
    n_groups = np.bincount(doc, minlength=len(texts))
    pair = a[last_a] << 32 | b[last_b]
    by = np.lexsort((pair, doc))
    new = np.flatnonzero((np.diff(doc[by], prepend=-1) != 0) | (np.diff(pair[by], prepend=-1) != 0))
    times = np.diff(new, append=len(by))
    lists = pa.array(starts_of(np.bincount(doc[by][new], minlength=len(texts))), pa.int32())
    at, written, digests = starts_of(n_a + n_b), tok.written, []
    for i, j in zip(at, at[1:], strict=False):
        digests.append(hashlib.sha256(b"".join(map(written.__getitem__, order[i:j].tolist()))[1:]).hexdigest() if j > i else "")
    # Tokens have a byte at least, so exactly one token of A and one of B end with a group.
    return pa.StructArray.from_arrays(
        [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_groups), pa.array(digests), pa.ListArray.from_arrays(lists, pa.array(pair[by][new])),
         pa.ListArray.from_arrays(lists, pa.array(times))], [f.name for f in ALIGNED])


def align(docs: DataFrame, *, text: str = "text", a: str = BYTES, b: str = PIECES) -> DataFrame:
    """``doc_id`` and the columns of ALIGNED for every row of ``docs``."""
    @F.arrow_udf(ALIGNED)
    def each(column: pa.Array) -> pa.Array:
        tok = tokenizers(a, b)
        return pa.concat_arrays([aligned(t, tok) for t in together(column.to_pylist())])

    return docs.select("doc_id", each.asNondeterministic()(F.col(text)).alias("s")).select("doc_id", "s.*")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): corpus-wide links of every pair of ids, and whether no pair of the same B has
    more."""
    counts = cut(rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    side = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(side.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return counts.withColumn("b", side).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """``rows`` with n_best and count_sum over their links. Counts are broadcast in blocks of ``most``
    pairs; both sums are added up block by block."""
    counts = cut(counts)
    blocks = max(1, -(-counts.count() // most))
    rows = rows.withColumn("sums", F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("total")))
    for i in range(blocks):
        t = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i).toArrow().sort_by("pair")
        shared = counts.sparkSession.sparkContext.broadcast((t["pair"].to_numpy(), t["n"].to_numpy(), t["best"].to_numpy()))
        if i:
            rows = cut(rows)
        rows = rows.withColumn("sums", _summed(shared)("pairs", "times", "sums"))
    return rows.select("*", F.col("sums.best").alias("n_best"), F.col("sums.total").alias("count_sum")).drop("sums")


def _summed(shared):
    @F.arrow_udf(T.StructType([T.StructField("best", T.LongType()), T.StructField("total", T.LongType())]))
    def add(pairs: pa.Array, times: pa.Array, before: pa.Array) -> pa.Array:
        keys, n, best = shared.value
        flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy()
        row = np.repeat(np.arange(len(pairs)), np.asarray(pairs.value_lengths()))
        out = [np.asarray(before.field(k)).copy() for k in range(2)]
        if len(keys) and len(flat):
            at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            known = keys[at] == flat
            np.add.at(out[0], row, often * (known & best[at]))
            np.add.at(out[1], row, often * np.where(known, n[at], 0))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["best", "total"])

    return add.asNondeterministic()


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of
    ``docs``. Null and empty texts, and texts whose ids don't spell them, have no tokens: zeros and an
    empty digest. Repeated rows count as often as they stand; other columns, whatever their names,
    are not read; an empty table gives an empty one. The strings of special tokens are plain text."""
    spark = docs.sparkSession
    folder = new_folder(spark)
    align(docs, **options).write.parquet(folder)
    rows = spark.read.parquet(folder)
    out = cut(with_counts(rows, pair_counts(rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    drop(spark, folder)
    return out
