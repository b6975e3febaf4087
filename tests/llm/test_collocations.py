"""Collocations against counts in plain Python, and the automata by themselves."""

import re
from collections import Counter

import numpy as np
import pytest

from visret.llm import collocations as c
from visret.llm.common import read

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    f = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, g in f.items():
        many = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            inside = [b for q, b in many.items() if len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:])]
            if not any(100 * b >= 50 * a for b in inside):
                score, _, left, right = min((1_000_000 * a * a // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(a for p, a in g.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, c.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_documents_equal_brute_force_whatever_the_ranges(spark, monkeypatch):
    d = read(spark, SF, "documents")
    rows = [(r.lang, r.text) for r in d.select("lang", "text").collect()]
    want = brute(rows)
    assert got(d) == want and len(want) > 50
    monkeypatch.setattr(c, "HOT", 50)
    assert got(d.repartition(7), size=500) == want
    assert got(d, least=3, top=20) == brute(rows, 3, 20)


def test_odd_rows(spark):
    rows = [(None, "A b C. " * 20), ("en", None), ("en", ""), ("en", " \t."), ("fr", "x " * 400), ("fr", "x " * 400), ("de", "q\x0br\x0cs t" * 15), ("de", "Ü ü " * 12), ("de", "\x00 z " * 11)]
    df = spark.createDataFrame([(lang, t, 1, "p") for lang, t in rows], "lang string, text string, word int, phrase string")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []
    assert c.collocations(df.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_long_pieces_are_taken_in_parts(spark, monkeypatch):
    rows = [("en", " ".join(str(i * i % 7) for i in range(3000)))]
    df, want = spark.createDataFrame(rows, "lang string, text string"), brute(rows)
    for part, shard in ((1, 1), (2, 50), (7, 100)):
        found = 0
        monkeypatch.setattr(c, "PART", part)
        monkeypatch.setattr(c, "SHARD", shard)
        ranges = c.ranges_of(c.word_counts(df), 10)
        for words in c.pieces(rows[0][1].encode()):  # as the tasks do it, which see these values only here
            shards = [c.Shard()]
            for i in range(0, max(1, len(words) - 2), part):
                shards[-1].add(words[i:i + part + 2], 2 if i + part + 2 < len(words) else 0)
                if shards[-1].full():
                    shards.append(c.Shard())
            total = Counter()
            for s in shards:
                for _, raw in s.automata(ranges):
                    a = c.Automaton.read(raw)
                    for x, y, z, n in zip(*a.paths(), strict=True):
                        total[tuple(a.words[k - 1] if k else b"" for k in (x, y, z))] += int(n)
            w = [*words, b"", b""]
            assert total == Counter(zip(w, w[1:], w[2:], strict=False)) - Counter({(b"",) * 3: 1})
            found += 1
        assert found == 1
    assert got(df) == want


@pytest.mark.parametrize("seed", range(5))
def test_automata_keep_paths_and_share_states(seed):
    rng = np.random.default_rng(seed)
    x, y, z = (rng.integers(low, 4, 60) for low in (1, 0, 0))
    paths = c.summed(x, y, z, np.ones(60, np.int64))
    words = [b"a", b"b", b"c"]
    a = c.Automaton.built(words, *paths)
    b = c.Automaton.read(a.written())
    assert b.words == words and all(np.array_equal(p, q) for p, q in zip(b.paths(), paths, strict=True))
    states = {bytes(np.stack([a.parts["third"], a.parts["weight"]])[:, i:j].tobytes()) for i, j in zip(a.parts["edges"], a.parts["edges"][1:], strict=False)}
    assert len(states) == len(a.parts["edges"]) - 1  # no two are equal
    union = c.Union()
    union.add(a)
    union.add(c.Automaton.built([b"c", b"d"], *(np.array([k]) for k in (1, 2, 0, 5))))
    ux, uy, uz, n = union.fold()
    names = [b"", *union.words]
    assert {(names[i], names[j], names[k]): m for i, j, k, m in zip(ux, uy, uz, n, strict=True)}[b"c", b"d", b""] == 5 and n.sum() == 65
