"""Language identification by compression.

For each language a zstandard dictionary holds raw text of that language. A text is compressed
with each of them and the language of the smallest result wins; of equal ones the first by name.
The score is how much smaller it is than the next, as a share; a narrow margin is a rejection.
Texts are encoded whole, in lower case and with ASCII marks and digits as spaces, in blocks of
``BLOCK`` bytes so that the dictionary stays in reach of the match finder. Every block, however
short, ends in the fixed incompressible ``TAIL``, without which zstandard stores most short texts
as they are; what the tail alone costs is taken off again.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, LEVEL = 1 << 15, 5
TAIL = np.random.default_rng(0).bytes(64)
#: Lower-case ASCII letters and all above 0x7F to themselves, other bytes to a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Fitting: texts are cut into passages of so many characters, and a language's dictionary holds so
#: many of them at most.
PASSAGE, PASSAGES = 2048, 64
#: Share by which the best must be smaller than the next, or the document is rejected.
MARGIN = 0.005
GUESS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def dictionaries(docs: DataFrame, *, text: str = "text", lang: str = "lang", passages: int = PASSAGES,
                 passage: int = PASSAGE) -> dict[str, bytes]:
    """Language -> raw dictionary, from the rows of ``docs`` that have both a text and a language.

    All passages of all texts stand for selection alike; those of the smallest hash are taken,
    ``passages`` a language: this is all that comes to the driver. Passages of copies count once. A
    language with any text at all is learned.
    """
    count = F.ceil(F.length(text) / passage).cast("int")
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), count.alias("n"))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    learned: dict[str, list[str]] = {}
    share = {name: min(1.0, 4 * passages / n) for name, n in known.items()}
    while share:  # where copies leave too few passages below a cut, it rises
        below = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
        draw = lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 40))
        places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: draw(i) < F.col("share") * (1 << 40))
        near = (rows.join(F.broadcast(below), "lang").select("lang", "text", "h", F.explode(places).alias("i"))
                .select("lang", draw(F.col("i")).alias("h"), F.substring("text", F.col("i") * passage + 1, F.lit(passage)).alias("text")))
        once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
        each = (once.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("h", "text"))).alias("all"))
                .select("lang", F.slice("all", 1, passages).getField("text").alias("texts")))
        got = {r["lang"]: r["texts"] for r in each.collect()}
        learned |= {name: got[name] for name, part in share.items() if part == 1 or len(got.get(name, ())) == passages}
        share = {name: min(1.0, 16 * part) for name, part in share.items() if name not in learned}
    return {name: b"\n".join(map(letters, texts)) for name, texts in learned.items()}


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def coder(raw: bytes):
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress


def sizes(raw: bytes, coders: list, bare: np.ndarray) -> np.ndarray:
    """Bytes that ``raw`` takes with each of the coders beyond ``bare`` a block, one at least."""
    total = np.zeros(len(coders))
    for i in range(0, len(raw), BLOCK):
        block = b" %b %b" % (raw[i:i + BLOCK], TAIL)
        total += [len(c(block)) for c in coders] - bare
    return np.maximum(total, 1)


def guesser(docs: DataFrame, learned: dict[str, bytes]):
    """A column function: text -> struct(lang, score). ``und`` with score 0 for null, for texts
    without a letter, and for all texts where no language was learned; score 1 where only one was."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(learned.items()))

    @F.arrow_udf(GUESS)
    def guess(array: pa.Array) -> pa.Array:
        names, coders = [n for n, _ in shared.value], [coder(raw) for _, raw in shared.value]
        best, score, bare = [], [], np.array([len(c(b" " + TAIL)) for c in coders])
        for text in array.to_pylist():
            if not names or not any(map(str.isalpha, text or "")):
                best.append("und")
                score.append(0.0)
                continue
            size = sizes(letters(text), coders, bare)
            order = np.argsort(size, kind="stable")
            best.append(names[order[0]])
            score.append(1 - size[order[0]] / size[order[1]] if len(order) > 1 else 1.0)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return guess.asNondeterministic()


def held_out(key: str, mod: int, rest: int) -> Column:
    """crc32(key as text) mod ``mod`` = ``rest``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, repeated ones each. Learned from the rows
    not held out; rows of null lang or text teach nothing, a null or letterless text is ``und``, a
    tie goes to the first name with score 0. Other columns, whatever their names, are not read."""
    out = held_out("doc_id", 5, 0)
    learned = dictionaries(docs.where(~out))
    guess = docs.select("doc_id", out.alias("held_out"), guesser(docs, learned)(F.col("text")).alias("g"))
    return guess.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))


def keep(docs: DataFrame, *, margin: float = MARGIN) -> DataFrame:
    """The documents whose language is clear, with their own columns: those go that have no letter
    or whose two best languages lie closer than ``margin``."""
    learned = dictionaries(docs.where(~held_out("doc_id", 5, 0)))
    name = "guess"
    while name in docs.columns:
        name += "_"
    g = F.col(name)
    sure = (g["lang"] != "und") & (g["score"] >= margin)
    return docs.withColumn(name, guesser(docs, learned)(F.col("text"))).where(sure).drop(name)
