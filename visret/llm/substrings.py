"""Substring dedup by relative Lempel-Ziv parsing.

A document is parsed against all documents of smaller doc_ids: a greedy factor runs on as long as its
words stand, at one distance, in one reference document. Words inside factors of ``WINDOW`` words
or more are duplicates. What stands across a factor's boundary is checked window by window.

The reference is indexed by anchors. Of the runs of ``ANCHOR`` words in a window the one of the least
hash is the window's anchor, so two equal windows have the same anchor wherever they stand, and the
anchors of consecutive windows overlap or touch. The index, which is cut by hash into as many blocks
as the shuffle has parts, names the first document of every anchor that two documents have and a
place there. Anchors of every document meet every block by a join; the index of frequent anchors is
small and broadcast instead. In the parse, consecutive windows
whose anchors lead to one document at one distance make a factor: all words between its first and
last anchor are equal to the reference's. Windows that no factor holds but whose anchor is known
(they cross a factor's boundary, or their anchor's first document goes on otherwise) are compared
as windows: by two hashes of 64 bits, each with the least doc_id that has it. Windows whose anchor
one document alone has are in no other document and never leave it.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import cut, drop, new_folder, starts_of, texts

WINDOW, ANCHOR = 13, 7
#: Bytes of texts whose anchors are looked for at a time (one text at least).
TOGETHER = 1 << 22
#: Documents of the sample in which frequent anchors are looked for, the share of it that makes one
#: frequent, how many are kept, and the parts that each is dealt to. They move rows, not results.
SAMPLE, SHARE, FREQUENT, PARTS = 4096, 128, 1 << 16, 64
#: Odd factors of the hashes of words, anchors and windows.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    for shift in (29, 32):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(MIX[0])
    return h ^ (h >> np.uint64(31))


def powers(n: int, by: int, start: int = 1) -> np.ndarray:
    out = np.full(n, by, np.uint64)
    out[:1] = start
    return np.multiply.accumulate(out, out=out)


def words_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``, which is also cut at ``bounds``. A word's hash is a
    polynomial in its bytes, taken as a difference of running sums, and so the same wherever it is."""
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begin = np.flatnonzero(word & (first[:-1] | ~np.r_[False, word[:-1]]))
    end = np.flatnonzero(word & (first[1:] | ~np.r_[word[1:], False])) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), MIX[2]), out=total[1:])
    back = powers(len(data) + 1, pow(MIX[2], -1, 1 << 64))
    return mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64) * np.uint64(MIX[1])), begin


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of texts that lie one after another in the bytes ``data``, from bounds[i] to
    bounds[i + 1], and where each text's words begin. Long texts are taken in parts that end at white
    space."""
    data = data[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    hashes, begins, i = [], [], 0
    while True:
        j = min(len(data), i + TOGETHER)
        while j < len(data) and not SPACE[data[j]]:
            ahead = np.flatnonzero(SPACE[data[j:j + 4096]])
            j = j + int(ahead[0]) if len(ahead) else min(len(data), j + 4096)
        own = bounds[(bounds >= i) & (bounds <= j)] - i
        h, begin = words_in(data[i:j], own)
        hashes.append(h)
        begins.append(begin + i)
        if j == len(data):
            break
        i = j
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)


def rolled(h: np.ndarray, size: int, by: int) -> np.ndarray:
    """A hash of every run of ``size`` of the hashes ``h``."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(by)
        out += h[k:k + n]
    return mixed(out)


def least(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the least hash of its runs of ANCHOR words, and where that run begins."""
    width = WINDOW - ANCHOR + 1
    if len(a) < width:
        return a[:0], np.zeros(0, np.int64)
    place = np.arange(len(a) - width + 1) + sliding_window_view(a, width).argmin(1)
    return a[place], place


def anchors_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor and place in it of the distinct anchors of texts whose words' hashes are ``h``, by
    text; of a repeated anchor the first place."""
    own, place = least(rolled(h, ANCHOR, MIX[0]))
    at = np.arange(len(own))
    text = np.searchsorted(bounds, at, side="right") - 1
    # Windows inside one text, and of those with the same run of words the first.
    inside = at + WINDOW <= bounds[text + 1]
    inside &= np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]][:len(at)]
    own, place, text = own[inside], place[inside], text[inside]
    order = np.lexsort((place, own, text))
    own, place, text = own[order], place[order], text[order]
    new = np.r_[True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])][:len(own)]
    return text[new], own[new], (place - bounds[text])[new]


def portions(array: pa.Array):
    """(first row, bytes, bounds) of parts of a column of strings; null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
        yield i, data, offsets[i:j + 1]
        i = j


def tagged(docs: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """(doc_id, tag, text) of the rows with a doc_id and a text. tag tells texts of one doc_id apart; it is
    0 where no doc_id comes twice, which is said."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    alone = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rows.select("doc_id", tag_of(text, alone).alias("tag"), F.col(text).alias("text")), alone


def tag_of(text: str, alone: bool) -> Column:
    """31 bits of a hash of the text, in the upper half."""
    return F.lit(0).cast("long") if alone else F.shiftleft(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 31)), 32)


def anchored(rows: DataFrame, frequent=None) -> DataFrame:
    """(anchor, doc_id, place, part): every anchor of every document once; place is its tag and first
    word, part the part that a frequent anchor's document is dealt to, else null."""
    def find(batches):
        hot = np.zeros(0, np.uint64) if frequent is None else frequent.value
        for batch in batches:
            for i, data, bounds in portions(batch.column(2)):
                h, at = word_hashes(data, bounds)
                text, key, place = anchors_of(h, at)
                row = pa.array(text + i)
                slot = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
                known = hot[slot] == key if len(hot) else np.zeros(len(key), bool)
                yield from pa.table([
                    pa.array(key.view(np.int64)), batch.column(0).take(row), pa.array(np.asarray(batch.column(1).take(row)) + place),
                    pa.array(np.asarray(batch.column(3).take(row)), pa.int32(), mask=~known)], names=["anchor", "doc_id", "place", "part"]).to_batches(10_000)

    schema = T.StructType([T.StructField("anchor", T.LongType()), rows.schema["doc_id"], T.StructField("place", T.LongType()), T.StructField("part", T.IntegerType())])
    return rows.select("doc_id", "tag", "text", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")).mapInArrow(find, schema)


def frequent_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors that a bounded sample of documents has often, sorted."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))
    often = anchored(some).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SAMPLE // SHARE)
    found = often.orderBy(F.desc("n"), "anchor").limit(FREQUENT).select("anchor").toArrow()["anchor"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def references(rows: DataFrame, folder: str) -> tuple[DataFrame, pa.Table]:
    """(anchor, doc_id, place, first, at): the anchors that two documents have, in every document, with
    the first of these documents and a place there. Of a frequent anchor only that a document has it;
    its first document and the place there are in the table beside it, FREQUENT rows at most.

    All anchors are shuffled once, to blocks of the index by their hash; documents of a frequent anchor
    are dealt to several parts, whose firsts are put together afterwards."""
    spark = rows.sparkSession
    frequent = frequent_anchors(rows)
    found = anchored(rows, spark.sparkContext.broadcast(frequent))
    w = Window.partitionBy("anchor", "part")
    least_ = found.withColumn("first", F.min("doc_id").over(w)).withColumn("last", F.max("doc_id").over(w)).withColumn("at", F.min_by("place", "doc_id").over(w))
    least_.where((F.col("first") < F.col("last")) | F.col("part").isNotNull()).write.parquet(folder)
    met = spark.read.parquet(folder)
    index = met.where("part is not null").groupBy("anchor").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("at", "first").alias("at")).where(F.col("first") < F.col("last"))
    return met.drop("last"), index.select("anchor", "first", "at").toArrow()


def parse(h: np.ndarray, anchor: np.ndarray, earlier: np.ndarray, first: np.ndarray, at: np.ndarray, found=None):
    """Greedy factors of a document, whose words' hashes are ``h``, against the index: ``anchor`` are its
    anchors there, sorted, each with the number of the reference document, whether it is an ``earlier``
    one, and the place in it. ``found`` are its windows' anchors, if they are known. Returns starts and ends (words, ends excluded) of factors of WINDOW
    words or more, and the starts, hashes and anchors of the windows to be checked, and whether an
    earlier document may have them."""
    own, place = least(rolled(h, ANCHOR, MIX[0])) if found is None else found
    n = len(own)
    if not n or not len(anchor):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    slot = np.minimum(np.searchsorted(anchor, own), len(anchor) - 1)
    there = anchor[slot] == own
    leads = there & earlier[slot]
    far = at[slot] - place
    same = leads[1:] & leads[:-1] & (first[slot][1:] == first[slot][:-1]) & (far[1:] == far[:-1])
    begin = np.flatnonzero(leads & ~np.r_[False, same])
    end = np.flatnonzero(leads & ~np.r_[same, False])
    starts, ends = place[begin], place[end] + ANCHOR
    long = ends - starts >= WINDOW
    starts, ends = starts[long], ends[long]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends - WINDOW + 1, -1)
    check = np.flatnonzero(there & (np.cumsum(mark[:-1]) == 0))
    return starts, ends, check, rolled(h, WINDOW, MIX[1])[check].view(np.int64), own[check].view(np.int64), earlier[slot][check].astype(np.int64)


PARSED = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends", "check", "window", "anchor", "ask")])


def parser(frequent):
    """Factors and windows to be checked of packed texts; refs are structs of anchor, first and at.
    ``frequent`` is a broadcast table of such rows, in which every text's anchors are looked up."""
    @F.arrow_udf(PARSED)
    def parsed(text: pa.Array, doc: pa.Array, refs: pa.Array) -> pa.Array:
        cols: list[list[np.ndarray]] = [[] for _ in PARSED]
        begin = starts_of(np.asarray(refs.value_lengths()))
        flat, hot = refs.flatten(), frequent.value.combine_chunks()
        anchor, at = (np.concatenate([flat.field(c).to_numpy(), hot[c].to_numpy()]) for c in ("anchor", "at"))
        anchor = anchor.view(np.uint64)
        # References that are one row have one number: documents by value, and tags.
        firsts = pa.chunked_array([flat.field("first"), *hot["first"].cast(flat.field("first").type).chunks]).combine_chunks()
        first = np.asarray(firsts.dictionary_encode().indices).astype(np.int64) << 32 | at >> 32
        earlier = np.asarray(pc.less(flat.field("first"), doc.take(pa.array(np.repeat(np.arange(len(doc)), np.diff(begin))))))
        many = len(flat) + np.argsort(anchor[len(flat):])
        known = anchor[many]
        for i, t in enumerate(text):
            raw = np.frombuffer(zstandard.decompress(t.as_py()), np.uint8)
            h = word_hashes(raw, np.array([0, len(raw)]))[0]
            windows = least(rolled(h, ANCHOR, MIX[0]))
            slot = np.unique(np.minimum(np.searchsorted(known, windows[0]), max(0, len(known) - 1)))
            some = many[slot[np.isin(known[slot], windows[0])]] if len(known) else many
            r = np.r_[np.arange(begin[i], begin[i + 1]), some]
            before = np.r_[earlier[begin[i]:begin[i + 1]], np.asarray(pc.less(firsts.take(pa.array(some)), doc[i])) if len(some) else np.zeros(0, bool)]
            order = np.argsort(anchor[r], kind="stable")
            r, before = r[order], before[order]
            got = parse(h, anchor[r], before, first[r], at[r] & 0xFFFFFFFF, windows)
            for c, x in zip(cols, got, strict=True):
                c.append(x)
        lists = [pa.ListArray.from_arrays(pa.array(starts_of(np.array([len(x) for x in c], np.int64)), pa.int32()), pa.array(np.concatenate(c) if c else np.zeros(0, np.int64))) for c in cols]
        return pa.StructArray.from_arrays(lists, PARSED.names)

    return parsed.asNondeterministic()


@F.arrow_udf(T.BinaryType())
def pack(text: pa.Array) -> pa.Array:
    """Texts for a shuffle in fewer bytes."""
    make = zstandard.ZstdCompressor(level=1)
    return pa.array([make.compress(t) for t in texts(text)], pa.binary())


def spans(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, bool]:
    """(doc_id, tag, starts, ends): of each document with duplicate spans their words (ends excluded),
    which may overlap; and whether every doc_id comes once. Rows without a doc_id or text neither have
    spans nor make any."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession)
    rows, alone = tagged(docs, text)
    low_half = F.lit((1 << 32) - 1)
    met, frequent = references(rows, f"{folder}/anchors")
    ref = F.when(F.col("part").isNull(), F.struct("anchor", "first", "at"))
    met = met.select("doc_id", (F.col("place") - F.col("place").bitwiseAND(low_half)).alias("tag"), ref.alias("ref"))
    # A set, as equal rows have equal anchors: no more of them than the text has, and no frequent ones.
    refs = met.groupBy("doc_id", "tag").agg(F.collect_set("ref").alias("refs"))
    packed = rows.select("doc_id", "tag", pack("text").alias("packed"))
    packed.join(refs, ["doc_id", "tag"]).select("doc_id", "tag", parser(spark.sparkContext.broadcast(frequent))("packed", "doc_id", "refs").alias("p")).select("doc_id", "tag", "p.*").write.parquet(f"{folder}/parsed")
    got = spark.read.parquet(f"{folder}/parsed")
    each = got.select("doc_id", "tag", F.explode(F.arrays_zip("check", "window", "anchor", "ask")).alias("w")).select("doc_id", "tag", "w.*")
    low = each.groupBy("window", "anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    low.write.parquet(f"{folder}/windows")
    low = spark.read.parquet(f"{folder}/windows")  # apart, so that a join with windows of very many documents can be split
    late = each.where("ask = 1").join(low, ["window", "anchor"]).where(F.col("doc_id") > F.col("first")).groupBy("doc_id", "tag").agg(F.collect_set("check").alias("check"))
    factors = got.where(F.size("starts") > 0).select("doc_id", "tag", "starts", "ends").dropDuplicates(["doc_id", "tag"])
    none = F.array().cast("array<bigint>")
    check = F.coalesce("check", none)
    out = cut(factors.join(late, ["doc_id", "tag"], "full").select(
        "doc_id", "tag", F.concat(F.coalesce("starts", none), check).alias("starts"), F.concat(F.coalesce("ends", none), F.transform(check, lambda s: s + WINDOW)).alias("ends")))
    drop(spark, folder)
    return out, alone


CLEANED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])


def kept_words(text: bytes, starts, ends) -> tuple[list[bytes], int]:
    words = text.split()
    if starts is None or not len(starts):
        return words, len(words)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, np.asarray(starts), 1)
    np.add.at(mark, np.asarray(ends), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()], len(words)


def cleaner(digest: bool):
    """Of a packed text, starts and ends: words, removed words, and the kept words joined by a space, or
    their SHA-256."""
    @F.arrow_udf(CLEANED)
    def clean(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        n, gone, out = [], [], []
        for t, s, e in zip(text, starts, ends, strict=True):
            kept, all_ = kept_words(zstandard.decompress(t.as_py()), s.values and s.values.to_numpy(), e.values and e.values.to_numpy())
            n.append(all_)
            gone.append(all_ - len(kept))
            out.append(hashlib.sha256(b" ".join(kept)).hexdigest() if digest else b" ".join(kept).decode())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], CLEANED.names)

    return clean.asNondeterministic()


def deduplicated(docs: DataFrame, *, text: str = "text", digest: bool = False, into: str = "deduplicated") -> DataFrame:
    """``docs`` with, in place of the text, a struct ``into``: n_words, n_removed and text, the words that
    are left joined by one space (with ``digest`` the SHA-256 of that).

    Words are runs of other characters than [\\x20\\x09-\\x0D]. A word goes if it lies in 13
    consecutive words that also stand in a document of a smaller doc_id, as the documents were given.
    A null text has no words. Rows of one doc_id are not smaller than each other; rows without a
    doc_id keep all words and take none from others. Other columns stay as they are, whatever their
    names; an empty table gives an empty one.
    """
    marks, alone = spans(docs, text=text)
    free = "span"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    doc, tag, starts, ends = (f"{free}_{c}" for c in marks.columns)
    own, raw, others = f"{free}_own", f"{free}_packed", [c for c in docs.columns if c != text]
    packed = docs.select(*others, tag_of(text, alone).alias(own), pack(F.col(text)).alias(raw))
    joined = packed.join(marks.toDF(doc, tag, starts, ends), (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(tag)), "left")
    return joined.select(*others, cleaner(digest)(F.col(raw), F.col(starts), F.col(ends)).alias(into))


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_sha256."""
    out = deduplicated(docs.select("doc_id", "text"), digest=True, into="d", **options)
    return out.select("doc_id", "d.n_words", "d.n_removed", F.col("d.text").alias("kept_sha256"))
