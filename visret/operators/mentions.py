"""Phrases of a lexicon table in texts, by runs of words, however many phrases there are."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visret.functions.parse import normalized

#: Phrases (some 100 bytes each) that are broadcast at most; more are shuffled by phrase.
BROADCAST_ROWS = 100_000
#: Tokens of a phrase at most; longer ones are an error.
LONGEST = 64


def tokens(text: Column) -> Column:
    """Words, and every other character by itself."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W"), F.lit(0))


def mentions(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, start, phrase, name): where phrases of ``lexicon(phrase, name)`` stand in
    ``texts(query_id, text)``, with no word character beside them; start counts tokens from 0.

    Both are normalised as queries are. Runs of as many tokens as any phrase has are made of every text and
    joined to the phrases, so the plan grows with the lengths of phrases, not with their number. Null and
    empty texts and phrases have no mentions; repeated phrases count once for each name."""
    words = lexicon.select(normalized(F.col("phrase")).alias("phrase"), "name").where("phrase <> ''").distinct()
    words = words.withColumn("size", F.size(tokens(F.col("phrase"))))
    sizes = sorted(r["size"] for r in words.select("size").distinct().limit(LONGEST + 1).collect())
    if sizes and sizes[-1] > LONGEST:
        raise ValueError(f"a phrase has more than {LONGEST} tokens")
    own = texts.select("query_id", tokens(normalized(F.col("text"))).alias("t"))
    last = F.size("t")

    def run(i: Column, n: int) -> Column:
        beside = lambda k: F.coalesce(F.regexp_like(F.try_element_at("t", k), F.lit(r"(?U)^\w")), F.lit(False))
        clear = ~((i > 0) & beside(F.greatest(i, F.lit(1)))) & ~beside(i + n + 1)
        return F.when(clear, F.struct(i.cast("int").alias("start"), F.array_join(F.slice("t", i + 1, n), "").alias("phrase")))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), last - n), lambda i: run(i, n))
        return F.when(last >= n, F.array_compact(every)).otherwise(F.array().cast("array<struct<start: int, phrase: string>>"))

    if not sizes:
        return own.select("query_id", F.lit(0).alias("start")).limit(0).join(words.select("phrase", "name"), F.lit(False))
    each = own.select("query_id", F.explode(F.concat(*[runs(n) for n in sizes])).alias("r")).select("query_id", "r.*")
    few = words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = words.select("phrase", "name")
    return each.join(F.broadcast(found) if few else found, "phrase").select("query_id", "start", "phrase", "name")


def named(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, names): of every text the names of which a phrase of ``lexicon(phrase, name, place)``
    occurs, each once, in the order of their least place."""
    place = lexicon.groupBy("name").agg(F.min("place").alias("place"))
    some = mentions(texts, lexicon).select("query_id", "name").distinct().join(place, "name")
    lists = some.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
    names = F.transform("n", lambda n: n["name"])
    return texts.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce(names, F.array().cast("array<string>")).alias("names"))
