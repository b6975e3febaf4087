"""Substring dedup against windows compared one by one."""

import hashlib
import random
import re

import numpy as np

from visret.llm import substrings
from visret.llm.common import read

SF = "/root/testdata/sf0.001"
WHITE = str.maketrans(dict.fromkeys(map(chr, [9, 10, 11, 12, 13]), " "))


def split(text):
    return [w for w in (text or "").translate(WHITE).split(" ") if w]


def brute(rows):
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - 12):
            if i is not None:
                k = tuple(w[s:s + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {j for s in range(len(w) - 12) if i is not None and first[tuple(w[s:s + 13])] < i for j in range(s, s + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in substrings.digest(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def made(seed, n_words, docs=60):
    """Texts of few words that share passages, whole, cut, shifted and repeated."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(n_words)]
    some = [[rng.choice(words) for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    out = []
    for i in range(docs):
        t = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(some)
            a = rng.randrange(len(p))
            t += p[a:a + rng.randrange(5, 40)] if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(20))]
        out.append((rng.randrange(docs) if rng.random() < 0.2 else i, " ".join(t)))
    return out


def test_made_texts_equal_brute_force(spark):
    for seed, n in ((1, 2), (2, 4), (3, 50), (4, 1)):
        rows = made(seed, n)
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"u{i}" for i in range(40))
    long = " ".join(str(i * i % 9973) for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, text), (4, text), (4, text + " more"), (5, text), (None, text), (6, "\x0b".join(text.split())), (7, " ".join(text.split())), (8, long),
            (9, "x " + long), (10, "a " * 5000), (11, "a " * 13), (12, "a " * 12)]
    df = spark.createDataFrame([(i, t, 1, "s", "t") for i, t in rows], "doc_id long, text string, starts int, span_tag string, deduplicated string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    kept = substrings.deduplicated(df, into="left").where("doc_id = 9").first()
    assert kept["left"]["text"] == "x" and kept["starts"] == 1 and kept["span_tag"] == "s"


def test_documents_equal_brute_force_and_long_texts_are_cut(spark, monkeypatch):
    d = read(spark, SF, "documents")
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    assert got(d) == want and sum(r[2] for r in want) > 0
    monkeypatch.setattr(substrings, "SHARE", 1 << 20)  # every anchor of the sample is frequent
    assert got(d) == want


def test_frequent_anchors_are_not_joined(spark, monkeypatch, tmp_path):
    """Documents that share one passage: its anchors are frequent and are in the small table alone."""
    monkeypatch.setattr(substrings, "SAMPLE", 64)
    monkeypatch.setattr(substrings, "SHARE", 32)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"o{i} " * 20 + passage + f" e{i}" * (i % 3)) for i in range(400)] + [(1000 + i, f"q{i} " + " ".join(f"r{i // 2}x{j}" for j in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met, frequent = substrings.references(substrings.tagged(df, "text")[0], str(tmp_path / "anchors"))
    assert min(frequent["first"].to_pylist()) == 0 and len(frequent) > 5
    assert not re.search(r"\bJoin|Join\b", met._jdf.queryExecution().executedPlan().toString())
    assert got(df) == brute(rows)
    names = [(f"{i:05d}", t) for i, t in rows]
    assert got(spark.createDataFrame(names, "doc_id string, text string")) == brute(names)


def hashed(*some):
    """Hashes of texts' words, and where each text's begin."""
    raw = [t.encode() for t in some]
    return substrings.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    h, at = hashed("a bc  d\x0be\n", "", " bc", "a", "d e\u00e9 bc")
    assert at.tolist() == [0, 4, 4, 5, 6, 9]
    monkeypatch.setattr(substrings, "TOGETHER", 3)
    parts, same = hashed("a bc  d\x0be\n", "", " bc", "a", "d e\u00e9 bc")
    assert parts.tolist() == h.tolist() and same.tolist() == at.tolist()
    assert h[0] == h[5] and h[1] == h[4] == h[8] and h[2] == h[6] and len(set(h.tolist())) == 5


def test_anchors_of_texts_together_are_those_of_each():
    some = [t for _, t in made(5, 6)] + ["", "x", "a b " * 30]
    h, at = hashed(*some)
    text, key, place = substrings.anchors_of(h, at)
    for i, t in enumerate(some):
        one = substrings.anchors_of(*hashed(t))
        assert key[text == i].tolist() == one[1].tolist() and place[text == i].tolist() == one[2].tolist()
        assert (len(one[1]) > 0) == (len(t.split()) >= 13)


def test_factors_leave_few_windows_to_check():
    """Of a long copy the factor holds all but the windows across its two boundaries."""
    h, at = hashed(" ".join(f"v{i * 7919 % 100_003}" for i in range(1000)))
    _, anchor, place = substrings.anchors_of(h, at)
    starts, ends, check, *_ = substrings.parse(h, anchor, np.ones(len(anchor), bool), np.zeros(len(anchor), np.int64), place)
    assert len(starts) == 1 and ends[0] - starts[0] > 980 and len(check) <= 12
