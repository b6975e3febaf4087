"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint is cut into segments of 23, 23 and 18 bits. With at most two differing bits one
segment is equal (pigeonhole) and the next one differs by two at most. The perfect Golay code
(23, 12) turns that into equal keys: every 23-bit word is given the indices of all codewords
within distance 4, six or one of them, and two words that differ by two bits or fewer always share
one (the codeword nearest to a word halfway between lies within 3 + 1 of both). A key is an equal
segment with a codeword index of the next; fingerprints are joined on keys and verified.

``groups`` links fingerprints of two differing bits at most. Of texts whose sets of five-word shingles
are similar by 0.8 or more it finds few, and wider keys of 64 bits meet by chance the more often the
more texts there are. So ``keep_dissimilar`` takes its first candidates from bands of the sets' least hashes
(MinHash), whose keys have 64 bits each, and verifies the texts. Bands miss some pairs and bring dissimilar
texts together that hold one passage. So then every text's least hashes are held against those of all others:
of texts that are similar so many must be equal. Those that have as many meet by their rarest shingles.
"""

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import LOWER, components, cut, expand, starts_of, texts
from visret.llm.substrings import MIX, mixed, rolled, word_hashes

SEED, SHINGLE, NEAR = 42, 3, 2
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PARTS = 4096  # a fingerprint with more than one in PARTS of all rows is joined in several parts
PART = 1 << 16  # shingles of one text that are counted at a time


def fingerprint_of(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    begins = starts_of(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - SHINGLE + 1)
    last = min(SHINGLE, len(words))
    ends = (begins[last:] - 1).tolist()
    begins = begins[:n].tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, PART):
        hashes = np.array([h(flat[a:b], SEED) for a, b in zip(begins[i:i + PART], ends[i:i + PART], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """Of whole texts; null and wordless ones give zero."""
    return pa.array(np.array([fingerprint_of(t) for t in texts(text)], np.uint64).view(np.int64))


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of every 12-bit upper part, and for each syndrome the error patterns of weight 4
    or less that have it (six or one; rows are filled up by repeating the first)."""
    def remainder(words):
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
        return words

    upper = remainder(np.arange(1 << 12, dtype=np.int64) << 11)
    patterns = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    syndrome = remainder(patterns)
    rows: list[list[int]] = [[] for _ in range(1 << 11)]
    for p, s in zip(patterns.tolist(), syndrome.tolist(), strict=True):
        rows[s].append(p)
    return upper, np.array([r + [r[0]] * (6 - len(r)) for r in rows], np.int64)


UPPER, ERRORS = golay_tables()


def indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices of the codewords within distance 4: six columns, in which
    the first is repeated where there is one alone."""
    syndrome = UPPER[words >> 11] ^ (words & 0x7FF)
    return (words[:, None] ^ ERRORS[syndrome]) >> 11


@F.arrow_udf(T.ArrayType(T.LongType()))
def keys(prints: pa.Array) -> pa.Array:
    fp = np.asarray(prints).astype(np.int64).view(np.uint64)
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    out = [np.int64(i) << 35 | seg[i][:, None] << 12 | indices(seg[(i + 1) % 3]) for i in range(3)]
    keep = np.concatenate([np.c_[np.ones(len(fp), bool), k[:, 1:] != k[:, :1]] for k in out], axis=1)
    return pa.ListArray.from_arrays(pa.array(starts_of(keep.sum(1)), pa.int32()), pa.array(np.concatenate(out, axis=1)[keep]))


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: the linked pairs among the distinct values of ``prints(fp)``."""
    keyed = prints.select("fp", F.explode(keys("fp")).alias("key"))
    a, b = (keyed.select("key", F.col("fp").alias(n)) for n in "ab")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR)
    return a.join(b, "key").where(near).select("a", "b").distinct()


def groups(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id``, fingerprint (16 hexadecimal digits) and component_id, one row per row of
    ``docs``.

    Equal fingerprints are one node, however many rows have them, so copies are never paired with
    each other. component_id is the smallest doc_id of the component; rows whose doc_id is null
    belong to components but never name them.
    """
    each = cut(docs.select("doc_id", fingerprint.asNondeterministic()(F.col(text)).alias("fp")))
    least = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = least.join(components(links(least.select("fp"))).withColumnRenamed("id", "fp"), "fp")
    best = linked.groupBy("component").agg(F.min("least").alias("best"))
    moved = linked.join(best, "component").select("fp", "best")
    named = least.join(moved, "fp", "left").select("fp", "n", F.coalesce("best", "least").alias("component_id"))
    # Rows of a fingerprint that many rows have are dealt to several parts, each with its name.
    share = max(1, (least.agg(F.sum("n")).first()[0] or 0) // PARTS)
    parts = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(least.where(F.col("n") > share).select("fp", parts.alias("parts")))  # no more than PARTS rows
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
    dealt = each.join(hot, "fp", "left").withColumn("part", part).drop("parts")
    named = named.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("n")
    return dealt.join(named, ["fp", "part"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Ids of documents that go (32 bytes each) are broadcast up to this size, beyond it documents and
#: ids are shuffled.
BROADCAST_BYTES = 32 << 20


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``ids(doc_id, kept, n)`` keeps, one of each doc_id (n counts its
    rows); rows without a doc_id stay. Whole documents are moved only where the ids of those that
    go are too many to broadcast."""
    lost, again = ids.where("not kept").select("doc_id"), ids.where("kept and n > 1").select("doc_id")
    n_lost, n_again = ids.agg(F.count_if(~F.col("kept")), F.count_if(F.col("kept") & (F.col("n") > 1))).first()
    out = docs.join(sized(lost, n_lost), "doc_id", "left_anti")
    if n_again:
        few = sized(again, n_again)
        out = out.join(few, "doc_id", "left_anti").unionByName(out.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(docs.columns)


def sized(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if 32 * n <= BROADCAST_BYTES else ids


def keep_one(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with one of each group, that of the smallest doc_id; of rows with the same
    doc_id one stays. Rows without a doc_id stay, for nothing can name them."""
    own = groups(docs, text=text).where("doc_id is not null").groupBy("doc_id")
    return with_ids(docs, cut(own.agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n"))))


WORDS, SIMILAR = 5, (4, 5)  # words of a verified shingle, and the similarity as a fraction
#: A first candidate shares a band: the least hashes of its shingles by so many functions. Of pairs similar by
#: 0.8 1 - (1 - 0.8 ** 5) ** 14 = 0.996 can be expected to share one, of those by 0.3 a thirtieth.
BANDS, ROWS = 14, 5
#: Of a set of n, 1 + n // TENTH more hashes than a shared one needs are held against others, so that as many are shared.
TENTH = 10
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)
TOGETHER = 1 << 18  # bytes of texts that are hashed at a time (one text at least)
SHARE = 4096  # rows of one key in one part of a join


def runs_of(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in lower case how many different shingles each has, and their hashes, text by text. Texts of
    fewer than ``WORDS`` words have none: they are similar to texts of the same words alone."""
    h, at = word_hashes(np.frombuffer(b"".join(some), np.uint8), starts_of(np.fromiter(map(len, some), np.int64, len(some))))
    text, place = expand(at[:-1], np.maximum(0, np.diff(at) - WORDS + 1))
    runs = rolled(h, WORDS, MIX[1])[place]
    order = np.lexsort((runs, text))
    text, runs = text[order], runs[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (runs[1:] != runs[:-1])][:len(text)]
    return np.bincount(text[new], minlength=len(some)), runs[new]


def bands(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in lower case how many different shingles each has, and of those that have any, in order, a
    key of 64 bits for each band."""
    size, runs = runs_of(some)
    count = size[size > 0]
    keys = np.zeros((len(count), BANDS), np.uint64)
    if len(count):
        begin = starts_of(count)[:-1]
        for i, factors in enumerate(FACTORS):
            keys[:, i] = i + 1
            for f in factors:
                keys[:, i] = mixed(keys[:, i] * np.uint64(MIX[0]) + np.minimum.reduceat(runs * f, begin))
    return size, keys


def together(some: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts as they come, so many at a time."""
    out, held = [], 0
    for t in some:
        if out and held + len(t) > TOGETHER:
            yield out
            out, held = [], 0
        out.append(t)
        held += len(t)
    if out:
        yield out


@F.arrow_udf(T.StructType().add("low", T.LongType()).add("high", T.LongType()).add("size", T.LongType()).add("keys", T.ArrayType(T.LongType())))
def sketch(text: pa.Array) -> pa.Array:
    """128 bits that tell the words of texts apart, the number of their shingles, and their bands' keys."""
    words, size, keys = bytearray(), [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.uint64)]
    for some in together(t.translate(LOWER) for t in texts(text)):
        for t in some:
            words += xxhash.xxh3_128_digest(b" ".join(t.split()))
        for out, x in zip((size, keys), bands(some), strict=True):
            out.append(x)
    both, size, keys = np.frombuffer(words, np.int64).reshape(-1, 2), np.concatenate(size), np.concatenate(keys)
    each = pa.ListArray.from_arrays(pa.array(starts_of(np.where(size > 0, BANDS, 0)), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(size, pa.int64()), each], ["low", "high", "size", "keys"])


def listed(text: pa.Array, count: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Hashes of each text's different shingles, the least first, ``count`` of them by how many there are."""
    size, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for some in together(t.translate(LOWER) for t in texts(text)):
        n, own = runs_of(some)
        size.append(count(n))
        runs.append(own[expand(starts_of(n)[:-1], size[-1])[1]])
    return pa.ListArray.from_arrays(pa.array(starts_of(np.concatenate(size)), pa.int32()), pa.array(np.concatenate(runs).view(np.int64)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def hashes(text: pa.Array) -> pa.Array:
    """Those of a text's different shingles."""
    return listed(text, lambda n: n)


def least_count(n: np.ndarray) -> np.ndarray:
    """How many of ``n`` hashes are held against others."""
    up, down = SIMILAR
    return np.minimum(n, n - (up * n + down - 1) // down + 1 + n // TENTH)


@F.arrow_udf(T.ArrayType(T.LongType()))
def least_hashes(text: pa.Array) -> pa.Array:
    return listed(text, least_count)


def shingles(text: bytes) -> set[bytes]:
    """Runs of five words; of fewer words, but not none, the whole."""
    words = text.translate(LOWER).split()
    return {b" ".join(words[i:i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()


def are_similar(a: bytes, b: bytes) -> bool:
    x, y = shingles(a), shingles(b)
    up, down = SIMILAR
    if min(len(x), len(y)) * down < max(len(x), len(y)) * up:
        return False
    both = len(x & y)
    return down * both >= up * (len(x) + len(y) - both)


@F.arrow_udf(T.BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([are_similar(x, y) for x, y in zip(texts(a), texts(b), strict=True)], pa.bool_())


def in_parts(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a column ``part``, over which rows of a frequent key are dealt, and how many
    ``parts`` each frequent key has; there is one such key in ``SHARE`` rows at most, so they are broadcast."""
    many = F.broadcast(rows.groupBy(key).agg(F.ceil(F.count("*") / SHARE).cast("long").alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1)))
    return rows.join(many, key, "left").withColumn("part", part).drop("parts"), many


def copied(rows: DataFrame, key: str, many: DataFrame) -> DataFrame:
    """``rows`` once for every part of their key."""
    last = F.coalesce("parts", F.lit(1)) - 1
    return rows.join(many, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts")


def keyed(nodes: DataFrame) -> DataFrame:
    """A row for each key, with how many shingles come before it in the order of ``rarest``, if it is one."""
    before = "before" if "before" in nodes.columns else F.lit(None).cast("long").alias("before")
    each = nodes.select("node", "size", "component", before, F.posexplode("keys").alias("place", "key"))
    return each.select("node", "size", "component", F.expr("coalesce(before + place, 0)").alias("at"), "key")


#: Sets of such sizes, whose first shingle in common has so many before it, can be similar.
FITTING = f"least(size - at, other - there) * {sum(SIMILAR)} >= (size + other) * {SIMILAR[0]}"


def least_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each of ``nodes(node, size, keys, component)`` with the least node of each of its keys, if
    that is of another component."""
    its = [F.min_by(c, "node").alias(name) for c, name in (("size", "other"), ("at", "there"), ("component", "its"))]
    first = keyed(nodes).groupBy("key").agg(F.min("node").alias("b"), *its, F.count("*").alias("n"))
    met = keyed(nodes).join(first.where("n > 1"), "key").where("b < node and component <> its").where(FITTING)
    return met.select(F.col("node").alias("a"), "b").distinct()


def other_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): those of ``nodes(node, size, keys, component)`` that share a key and are of two components.

    Of a key that several components have, the nodes outside its largest one meet all. So nodes of one
    component are not paired, however many share a key. Keys with more than ``SHARE`` such nodes are
    joined in parts."""
    each = keyed(nodes)
    shares = each.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed_keys = cut(shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components")).where("components > 1").select("key", "main"))
    some = cut(each.join(mixed_keys, "key"))
    left, many = in_parts(some.where("component <> main").drop("main"), "key")
    renamed = [F.col(c).alias(name) for c, name in (("node", "b"), ("size", "other"), ("at", "there"), ("component", "its"))]
    right = copied(some.select("key", *renamed, (F.col("component") != F.col("main")).alias("too")), "key", many)
    # Of two nodes that both meet all, the pair is taken once.
    met = left.join(right, ["key", "part"]).where("component <> its and (not too or b < node)").where(FITTING)
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def left_apart(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``nodes(node, size, component)`` that may be similar to a node of another component, by their
    texts in ``docs(doc_id, text)``, which may hold copies of nodes.

    Similar sets of n and m have the 4 n / 5 and 4 m / 5 greater of all their hashes in common, or more, so of
    those in common the k least are among the n / 5 + k least of n and the m / 5 + k least of m. With k of
    1 + n / 10 a node whose least hashes are not shared so often, by whichever nodes of other components,
    is similar to none of them: no pair is missed. A passage in common makes few texts share as many."""
    others = docs.select("doc_id").join(nodes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    others = cut(others.where("component is null or component <> doc_id").withColumn("known", F.lit(True)))
    some = docs.join(sized(others, others.count()), "doc_id", "left").where("known is null or component is not null")
    each = some.select(F.col("doc_id").alias("node"), F.coalesce("component", "doc_id").alias("component"), F.explode(least_hashes("text")).alias("key"))
    of = Window.partitionBy("key")
    shared = each.withColumns({"first": F.min("component").over(of), "last": F.max("component").over(of)}).where("first < last")
    up, down = SIMILAR
    enough = f"n >= 1 + ((size * {up} + {down - 1}) div {down}) div {TENTH}"
    return nodes.join(shared.groupBy("node").agg(F.count("*").alias("n")), "node").where(enough).drop("n")


def rarest(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes(node, size, component)`` with other ``keys``: the first shingles of each text in ``docs(doc_id,
    text)`` by how many of ``nodes`` have them, so many that two similar ones share one of them.

    A set of n is similar only to sets that have 4 n / 5 of it, so all but that many and one more are
    looked at (prefix filter), and what many dissimilar texts share comes last. Shingles of one node alone
    come first and meet nothing; they are only counted, in ``before``. Nodes without keys are left out."""
    nodes = cut(nodes.select("node", "size", "component"))
    some = docs.join(sized(nodes.select(F.col("node").alias("doc_id")), nodes.count()), "doc_id", "left_semi")
    each = some.select(F.col("doc_id").alias("node"), F.explode(hashes("text")).alias("key"))
    shared = cut(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = each.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key")))["key"].alias("keys"))
    up, down = SIMILAR
    looked_at = F.expr(f"greatest(0, size - (size * {up} + {down - 1}) div {down} + 1 - before)").cast("int")
    before = nodes.join(met, "node").withColumn("before", F.col("size") - F.size("keys"))
    return cut(before.withColumn("keys", F.slice("keys", F.lit(1), looked_at)).where("size(keys) > 0"))


def joined(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with the components that ``names(component, whole)`` are parts of."""
    return rows.join(names, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts in ``docs(doc_id, text)`` are similar."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    some = docs.join(sized(wanted, wanted.count()), "doc_id", "left_semi")
    left, many = in_parts(pairs, "b")
    left = left.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    right = copied(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", many)
    return left.join(right, ["b", "part"]).where(similar("text_a", "text_b")).select("a", "b")


def keep_dissimilar(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with one, that of the smallest doc_id, of each group that have the same words
    or are similar: five-word shingles as sets, Jaccard similarity of 0.8 or more, all such pairs. Of rows with the same doc_id one stays. Null texts have no words
    and are copies of each other; rows without a doc_id stay. Empty tables give empty ones.

    Texts with the same words are one node. Nodes first meet the least node of each band alone, so
    that a large group is not paired out. Those that may be similar to a node of another component then
    meet in the same way by their rarest shingles, and at last all of different components that share one of
    those. The groups are the components of all verified pairs.
    """
    named = docs.where("doc_id is not null").select("doc_id", F.col(text).alias("text"))
    each = cut(named.select("doc_id", sketch.asNondeterministic()("text").alias("s")).select("doc_id", "s.*"))
    # Of rows with one doc_id, those of the least words stand for it.
    one = [F.min_by(c, "low").alias(c) for c in ("high", "size", "keys")]
    own = cut(each.groupBy("doc_id").agg(*one, F.min("low").alias("low"), F.count("*").alias("n")))
    again = own.where("n > 1").select("doc_id", "low")
    if not again.isEmpty():
        twice = named.join(again.select("doc_id"), "doc_id", "left_semi").withColumn("low", sketch("text")["low"])
        twice = twice.join(again, ["doc_id", "low"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
        named = named.join(again, "doc_id", "left_anti").unionByName(twice)
    nodes = own.groupBy("low", "high").agg(F.min("doc_id").alias("node"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"))
    nodes = cut(nodes.select("node", "size", "keys", F.col("node").alias("component")))
    linked = cut(verified(least_pairs(nodes), named))
    nodes = cut(joined(nodes, components(linked).toDF("component", "whole")))
    some, of = rarest(left_apart(nodes.select("node", "size", "component"), named), named), nodes.select("node", "component")
    for pairs in (least_pairs, other_pairs):
        more = cut(verified(pairs(some), named))
        if not more.isEmpty():
            ends = more.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b")
            names = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))).toDF("component", "whole")
            of, some = cut(joined(of, names).select("node", "component")), cut(joined(some, names))
    kept = of.where("node = component").select(F.col("node").alias("doc_id"), F.lit(True).alias("kept"))
    return with_ids(docs, cut(own.join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"), "n")))
