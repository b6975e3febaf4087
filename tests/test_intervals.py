"""Overlaps of intervals and of garments with coloured spans, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from visret.functions import parse
from visret.functions.lexicon import DEFAULT, Lexicon
from visret.operators import intervals


def test_intervals_outside_equal_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice(["h"] * 5 + ["k", None]), (s := rng.randrange(-50, 200)), s + rng.choice([-1, 0, 1, 1, 3, 80]), i % 3) for i in range(n)]
    a, b = some(300), some(60)
    a += a[:5] + [("h", None, 5, 0), ("h", 5, None, 0)]
    schema = "key string, s long, e long, row int"
    for width in (1, 7, 1000):
        got = intervals.outside(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema), ["key"], "s", "e", width)
        hit = lambda x: None not in x[:3] and x[1] < x[2] and any(y[0] == x[0] and y[1] < y[2] and y[1] < x[2] and y[2] > x[1] for y in b)
        assert sorted(map(tuple, got.select("key", "s", "e", F.col("row")).collect()), key=repr) == sorted((x for x in a if not hit(x)), key=repr)
    assert intervals.outside(spark.createDataFrame(a, schema), spark.createDataFrame([], schema), ["key"], "s", "e", 7).count() == len(a)


def plainly(text, lex):
    text = " ".join(text.lower().split())
    thing, color, much = ("|".join(map(re.escape, p)) for p in (sorted(lex.garments, key=lambda g: -len(g)), lex.colors, lex.intensifiers))
    out, taken = [], []
    for m in re.finditer(rf"\b(?:({much})\s+)?({color})\s+({thing})s?\b", text):
        out.append(" ".join(filter(None, m.groups())))
        taken.append(m.span())
    for m in re.finditer(rf"\b({thing})s?\b", text):
        if not any(m.start() < e and m.end() > s for s, e in taken):
            out.append(m[1])
    return list(dict.fromkeys(out))


def test_garments_with_colours_inside(spark):
    lex = Lexicon(colors=("red", "blue"), intensifiers=("dark",), garments=("hat red", "red hat", "hat", "shirt", "blue"), scenes={}, styles={}, actions=(), confusable={}, otherwise=())
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["hat", "red", "blue", "shirt", "dark", "hats", "x", "shirts,", "\x01"]) for _ in range(rng.randrange(9))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = {r.t: r.b for r in rows.select("t", parse.bindings(parse.normalized(F.col("t")), lex).alias("b")).collect()}
    assert got == {t: plainly(t, lex) for t in texts}
    assert got.get("x") in ([], None) and plainly("hat red shirt", lex) == ["red shirt"]
    rows = spark.createDataFrame([("a red tie, blue t-shirts and boots",)], "t string")
    r = rows.select(parse.bindings(F.col("t")).alias("b"), parse.spans(F.col("t"), "(tie|boot)s?").alias("s")).first()
    assert r.b == plainly("a red tie, blue t-shirts and boots", DEFAULT) and [tuple(x) for x in r.s] == [(6, 9, "tie"), (29, 34, "boot")]
