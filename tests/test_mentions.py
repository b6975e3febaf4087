"""A lexicon as a table against one regular expression per phrase."""

import random
import re

from pyspark.sql import functions as F

from visret.functions import parse
from visret.functions.lexicon import SCENES
from visret.operators import mentions

SPACE = re.compile(r"\s+")


def plain(t):
    return SPACE.sub(" ", t.lower()).strip()


def test_ten_thousand_phrases_equal_brute_force_and_the_plan_stays(spark):
    rng = random.Random(2)
    words = ["a", "b", "t", "shirt", "Ünder", "x_y", "red", "-", "'", "  ", "."]
    made = lambda n: "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(n))
    texts = [(i, made(rng.randrange(12))) for i in range(60)] + [(100, None), (101, "")]
    phrases = [made(rng.randrange(1, 4)) for _ in range(400)] + [" ".join(f"w{rng.randrange(99)}" for _ in range(3)) for _ in range(10_000)] + ["", None]
    t = spark.createDataFrame(texts, "query_id int, text string").repartition(3)
    lexicon = spark.createDataFrame([(p, "n") for p in phrases], "phrase string, name string")
    got = {(r.query_id, r.phrase) for r in mentions.mentions(t, lexicon).collect()}
    known = {plain(p) for p in phrases if p and plain(p)}
    assert got == {(i, p) for i, x in texts if x for p in known if re.search(rf"(?<!\w){re.escape(p)}(?!\w)", plain(x))} and len(got) > 50
    plans = [mentions.mentions(t, lexicon.limit(n).unionByName(lexicon.limit(400)))._jdf.queryExecution().analyzed().toString() for n in (1, 9000)]
    assert abs(len(plans[0]) - len(plans[1])) < 500


def test_names_equal_the_column_form(spark):
    texts = spark.createDataFrame([(1, "A walk in the  Park bench"), (2, "modern office, downtown"), (3, "parking"), (4, None)], "query_id int, text string")
    lexicon = spark.createDataFrame([(a, n, i) for i, (n, own) in enumerate(SCENES.items()) for a in own], "phrase string, name string, place int")
    want = {r.query_id: r.n for r in texts.select("query_id", parse.named(parse.normalized(F.coalesce("text", F.lit(""))), SCENES).alias("n")).collect()}
    assert {r.query_id: r.names for r in mentions.named(texts, lexicon).collect()} == want and want[2] == ["modern office", "urban street"]
    assert mentions.mentions(texts, lexicon.limit(0)).collect() == []
