"""Phrase collocation mining with weighted acyclic automata.

Every shard of texts turns its n-grams, sorted, into count transducers: acyclic automata whose paths are
the three words from each place on (an end mark where the piece ends) and whose paths' weights are
counts. They are built incrementally from the sorted n-grams, state by state, and equal states (the
same words with the same weights to the end) are one. A shard writes one automaton for each language
and range of prefixes. Automata of one range meet in one task, which unites them and adds up their
weights; the count of a phrase is the sum of the weights below its prefix. Parts of a phrase lie
below other prefixes, so their counts are composed by joins of the candidates' parts with the
united counts.

Ranges hold about as many words each. They are cut from the exact counts of all words, of which the
driver gets sums by the first two bytes of words (65,536 at most) and the words that stand for more
than one in ``HOT`` of all (``HOT`` at most); those words are split further by their second word.
"""

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visret.llm.common import cut, expand, starts_of, texts

LEAST, SHARE, TOP, UNIT = 10, 50, 2000, 1_000_000  # occurrences, percent, phrases of a language, score of 1
#: Words of a range, and of a shard (words, and different words) at most; 20 bits number a word.
RANGE, SHARD, BITS, HOT = 1 << 20, 1 << 21, 20, 1024
PART = 1 << 16  # words of a piece that are taken at a time

# A-Z to lower case, piece ends to a line feed, tab to a space.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of each piece that has any. A piece has no white space but spaces, so split() cuts there."""
    return (words for p in text.translate(PIECES).split(b"\n") if (words := p.split()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of ``docs(lang, text)``."""
    def count(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                c = held.setdefault(lang, Counter())
                for words in pieces(text):
                    c.update(words)
                if len(c) >= 1 << BITS:
                    yield from counted(lang, c)
                    c.clear()
        for lang, c in held.items():
            yield from counted(lang, c)

    def counted(lang, c):
        if c:
            yield from pa.table([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())],
                                names=["lang", "word", "n"]).to_batches(10_000)

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Ranges:
    """To which range of prefixes an n-gram belongs."""

    def __init__(self, sums: dict[bytes, int], hot: dict[bytes, int], size: int):
        #: First prefixes of the ranges, the first range of each, and how many each has.
        self.begins, self.base, self.parts, self.hot = [], [], [], {}
        n, held = 0, size
        for prefix in sorted(sums):
            own = sums[prefix]
            if held + own > size:
                self.begins.append(prefix)
                self.base.append(n)
                self.parts.append(max(1, -(-own // size)))
                n += self.parts[-1]
                held = 0
            held += own
        for word in sorted(hot):
            self.hot[word] = (n, max(1, -(-hot[word] // size)))
            n += self.hot[word][1]
        self.n = n

    def of(self, word: bytes) -> tuple[int, int]:
        """First range of a first word and, where the second word tells, how many; else the range."""
        if word in self.hot:
            return self.hot[word]
        i = max(0, bisect_right(self.begins, word[:2]) - 1)
        return self.base[i] + zlib.crc32(word) % self.parts[i], 1


def ranges_of(counts: DataFrame, size: int) -> Ranges:
    """By word counts of all languages together, so that a range is one of words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = {r[0].encode(): r[1] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > total // HOT).collect()} if total else {}
    two = F.substring(F.col("word").cast("binary"), 1, 2)
    sums = {bytes(r[0]): r[1] for r in counts.groupBy(two.alias("two")).agg(F.sum("n").alias("n")).collect()}
    for word, n in hot.items():  # no more than HOT; they have ranges of their own
        sums[word[:2]] -= n
    return Ranges(sums or {b"": 0}, hot, size)


class Automaton:
    """Paths of three words (0 is the end mark) with their counts, as states.

    ``words`` are sorted, and word k is words[k - 1]. The start has an edge for each of ``first``; edge
    i leads to the state whose edges are at[i] to at[i + 1] of ``second``, and each of those to a
    state, ``state``, whose edges, with weights, are given by ``edges``, ``third`` and ``weight``."""

    KINDS = ("first", "at", "second", "state", "edges", "third", "weight")

    def __init__(self, words: list[bytes], **parts: np.ndarray):
        self.words, self.parts = words, parts

    @staticmethod
    def built(words: list[bytes], x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> "Automaton":
        """From sorted paths, each once. A state that is whole is looked up among those that were, by
        its edges and weights, before it is made."""
        new_xy = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(x) else np.zeros(0, bool)
        begin = np.flatnonzero(new_xy)
        length = np.diff(begin, append=len(x))
        state = np.zeros(len(begin), np.int64)
        # States of one edge are told apart by word and weight at once, longer ones by all of theirs.
        one = length == 1
        edge = begin[one]
        single, state[one] = np.unique(np.stack([z[edge], n[edge]]), axis=1, return_inverse=True) if len(edge) else (np.zeros((2, 0), np.int64), 0)
        register: dict[bytes, int] = {}
        kept = []
        both = np.stack([z, n], axis=1)
        for i in np.flatnonzero(~one).tolist():
            key = both[begin[i]:begin[i] + length[i]].tobytes()
            if key not in register:
                register[key] = single.shape[1] + len(kept)
                kept.append(i)
            state[i] = register[key]
        kept = np.array(kept, np.int64)
        _, at = expand(begin[kept], length[kept])
        new_x = np.flatnonzero(np.r_[True, x[begin][1:] != x[begin][:-1]]) if len(begin) else begin
        return Automaton(words, first=x[begin][new_x], at=np.r_[new_x, len(begin)], second=y[begin], state=state,
                         edges=starts_of(np.r_[np.ones(single.shape[1], np.int64), length[kept]]), third=np.r_[single[0], z[at]], weight=np.r_[single[1], n[at]])

    def paths(self) -> tuple[np.ndarray, ...]:
        """The sorted paths again: x, y, z and n."""
        p = self.parts
        edge, path = expand(p["edges"][p["state"]], np.diff(p["edges"])[p["state"]])
        return np.repeat(p["first"], np.diff(p["at"]))[edge], p["second"][edge], p["third"][path], p["weight"][path]

    def written(self) -> bytes:
        """Every list in the fewest bytes a number, behind their sizes."""
        body, head = [], []
        for k in self.KINDS:
            a = self.parts[k]
            kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) < 1 << 8 * int(t[2]))
            body.append(a.astype(kind).tobytes())
            head += [len(a), int(kind[2])]
        return np.array(head, "<u8").tobytes() + b"".join(body) + b" ".join(self.words)

    @staticmethod
    def read(raw: bytes) -> "Automaton":
        head, at, parts = np.frombuffer(raw, "<u8", 2 * len(Automaton.KINDS)).tolist(), 16 * len(Automaton.KINDS), {}
        for k, n, size in zip(Automaton.KINDS, head[::2], head[1::2], strict=True):
            parts[k] = np.frombuffer(raw, f"<u{size}", n, at).astype(np.int64)
            at += n * size
        return Automaton(raw[at:].split(b" ") if len(raw) > at else [], **parts)


def summed(x: np.ndarray, y: np.ndarray, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted paths, each once, with the sums of their weights."""
    order = np.lexsort((z, y, x))
    x, y, z, n = x[order], y[order], z[order], n[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]) if len(x) else np.zeros(0, np.int64)
    return x[new], y[new], z[new], np.add.reduceat(n, new) if len(new) else n


class Union:
    """Of automata of one range: paths over one list of words, united whenever many have come."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.held, self.size, self.limit = [], 0, 2 * SHARD

    def add(self, a: Automaton) -> None:
        number = np.array([0, *[self.words.setdefault(w, len(self.words) + 1) for w in a.words]], np.int64)
        x, y, z, n = a.paths()
        self.held.append((number[x], number[y], number[z], n))
        self.size += len(x)
        if self.size > self.limit:
            self.fold()
            self.limit = max(2 * SHARD, 2 * self.size)

    def fold(self) -> tuple[np.ndarray, ...]:
        self.held = [summed(*map(np.concatenate, zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0])
        return self.held[0]


class Shard:
    """Words of one language, as numbers; 0 ends a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.again: list[int] = []

    def add(self, words: list[bytes], again: int) -> None:
        """Take words of one piece; the last ``again`` of them only end n-grams."""
        number = self.number
        for w in words:
            if w not in number:
                number[w] = len(number) + 1
        self.ids.extend(map(number.__getitem__, words))
        self.again.extend(range(len(self.ids) - again, len(self.ids)))
        self.ids.append(0)

    def full(self) -> bool:
        return len(self.ids) >= SHARD or len(self.number) >= 1 << BITS - 1

    def automata(self, ranges: Ranges) -> Iterator[tuple[int, bytes]]:
        """Range and automaton, written, of all n-grams."""
        words = sorted(self.number)
        sorted_ = np.zeros(len(words) + 1, np.int64)
        sorted_[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        ids = np.r_[sorted_[np.array(self.ids, np.int64)], 0, 0]
        x, y, z = ids[:-2], ids[1:-1], ids[2:]
        z = np.where(y == 0, 0, z)  # what follows a piece's end is another piece
        used = x > 0
        used[self.again] = False
        key, n = np.unique((x[used] << 2 * BITS) | (y[used] << BITS) | z[used], return_counts=True)
        mask = (1 << BITS) - 1
        x, y, z = key >> 2 * BITS, key >> BITS & mask, key & mask
        base, parts = (np.array(c, np.int64) for c in zip((0, 1), *map(ranges.of, words), strict=True))
        split = np.flatnonzero(parts[x] > 1)
        place = base[x]
        if len(split):
            pair, of = np.unique(key[split] >> BITS, return_inverse=True)
            some = [zlib.crc32(words[p - 1] if p else b"") for p in (pair & mask).tolist()]
            place[split] += np.array(some, np.int64)[of] % parts[x[split]]
        order = np.argsort(place, kind="stable")
        bounds = np.r_[np.flatnonzero(np.diff(place[order], prepend=-1)), len(order)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            at = order[i:j]
            own = np.unique(np.r_[x[at], y[at], z[at]])
            own = own[own > 0]
            number = np.zeros(len(words) + 1, np.int64)
            number[own] = np.arange(1, len(own) + 1)
            a = Automaton.built([words[k - 1] for k in own.tolist()], number[x[at]], number[y[at]], number[z[at]], n[at])
            yield int(place[order[i]]), a.written()


def transducers(docs: DataFrame, ranges: Ranges) -> DataFrame:
    """(range, lang, automaton) of shards of ``docs(lang, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranges)

    def build(batches):
        held: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for words in pieces(text):
                    for i in range(0, max(1, len(words) - 2), PART):
                        some = words[i:i + PART + 2]
                        shard = held.setdefault(lang, Shard())
                        shard.add(some, 2 if i + PART + 2 < len(words) else 0)
                        if shard.full():
                            yield from rows(lang, held.pop(lang))
        for lang in list(held):
            yield from rows(lang, held.pop(lang))

    def rows(lang, shard):
        for at, raw in shard.automata(shared.value):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([lang], pa.string()), pa.array([raw], pa.binary())], ["range", "lang", "automaton"])

    return docs.mapInArrow(build, "range int, lang string, automaton binary")


def united(rows: DataFrame, tasks: int, least: int) -> DataFrame:
    """(lang, a_word, b_word, c_word, a, l2): phrases of two words (c_word is null) and three that occur
    ``least`` times or more, and, of three, how often the first two do."""
    schema = "lang string, a_word string, b_word string, c_word string, a long, l2 long"

    def found(lang, union):
        x, y, z, n = union.fold()
        words = np.array([b"", *union.words], object)
        new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        two = np.add.reduceat(n, new)
        often = np.repeat(two, np.diff(new, append=len(n)))
        b, c = new[(y[new] > 0) & (two >= least)], np.flatnonzero((z > 0) & (n >= least))
        text = lambda k: pa.array(words[k].tolist(), pa.binary()).cast(pa.string())
        for at, third, count, first in ((b, pa.nulls(len(b), pa.string()), often[b], pa.nulls(len(b), pa.int64())), (c, text(z[c]), n[c], pa.array(often[c]))):
            yield from pa.table([pa.array([lang] * len(at), pa.string()), text(x[at]), text(y[at]), third, pa.array(count), first],
                                names=["lang", "a_word", "b_word", "c_word", "a", "l2"]).to_batches(10_000)

    def unite(batches):
        last, union = None, None
        for batch in batches:
            for at, lang, raw in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if (at, lang) != last:
                    if union:
                        yield from found(last[1], union)
                    last, union = (at, lang), Union()
                union.add(Automaton.read(raw))
        if union:
            yield from found(last[1], union)

    ordered = rows.repartition(tasks, "range", "lang").sortWithinPartitions("range", "lang")
    return ordered.mapInArrow(unite, schema)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` of ``united`` with phrase, a, l, r and score of the lowest-scoring cut, those that stand
    inside longer ones left out; ``words`` are (lang, word, n) of all that a phrase can have."""
    two, three = phrases.where("c_word is null").drop("c_word", "l2"), phrases.where("c_word is not null")
    f = lambda at, n: words.select("lang", F.col("word").alias(at), F.col("n").alias(n))

    def cut_score(left: str, right: str) -> Column:
        return F.expr(f"(cast({UNIT} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")

    inside = three.select("lang", "a_word", "b_word", "a").unionByName(three.select("lang", F.col("b_word").alias("a_word"), F.col("c_word").alias("b_word"), "a"))
    inside = inside.groupBy("lang", "a_word", "b_word").agg(F.max("a").alias("longest"))
    free = two.join(inside, ["lang", "a_word", "b_word"], "left").where(f"longest is null or 100 * longest < {SHARE} * a")
    pair = free.join(f("a_word", "l"), ["lang", "a_word"]).join(f("b_word", "r"), ["lang", "b_word"])
    pair = pair.select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), "a", "l", "r", cut_score("l", "r").alias("score"))
    rest = two.select("lang", F.col("a_word").alias("b_word"), F.col("b_word").alias("c_word"), F.col("a").alias("r2"))
    triple = three.join(rest, ["lang", "b_word", "c_word"]).join(f("a_word", "l1"), ["lang", "a_word"]).join(f("c_word", "r1"), ["lang", "c_word"])
    one = F.struct(cut_score("l1", "r2").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r2").alias("r"))
    other = F.struct(cut_score("l2", "r1").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r1").alias("r"))
    triple = triple.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), "a", F.least(one, other).alias("c"))
    return pair.unionByName(triple.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of every language, cut in parts of each language first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, size: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of every language the ``top`` phrases of two or three
    words that occur ``least`` times or more.

    A null text is empty, a null language is ``und``; repeated rows count as often as they stand; ties
    go by occurrences, then by bytes; other columns, whatever their names, are not read; an empty table
    gives an empty one. A phrase that mostly (half or more) stands in one longer one is left out.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = cut(word_counts(rows))
    ranges = ranges_of(counts, size)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges.n)
    phrases = cut(united(transducers(rows, ranges), tasks, least))
    n = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    best = ranked(scored(phrases, counts.where(F.col("n") >= least)), top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
