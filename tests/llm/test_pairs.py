"""Near duplicates, decontamination and license scans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from visret.llm import common, decontam, licenses, simhash, vector_dedup
from visret.llm.common import read

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, found string, score string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "cc by"), (4, "A b C d e f g h i j k l"), (5, "x " * 50_000 + "All rights  reserved."), (6, "É" * 30)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in ODD], DOCS)


def words(text):
    return WORD.findall((text or "").translate(AZ))


def reach(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 400)] + [(0, i) for i in range(1, 90)] + [(7, 7), (-5, -3), (-3, -5)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(100, 401)}, **{i: 0 for i in range(90)}, -5: -5, -3: -5}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_digest(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i:i + window]), set()).add(str(name if name is not None else ""))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    d, b = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    want = exact_digest([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert sorted((tuple(r) for r in decontam.digest(d, b).collect()), key=repr) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_decontamination_of_odd_rows_in_small_blocks(spark):
    items = [(10, "b c d"), (10, "b c d"), (2, "x"), (9, None), (8, "..."), (None, "rights reserved"), (3, "A B C D E F G H I J K L"), (7, "x " * 40)]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = exact_digest(ODD, items)
    assert sorted((tuple(r) for r in decontam.digest(odd(spark), b).collect()), key=repr) == want
    assert sorted((tuple(r) for r in decontam.digest(odd(spark), b, block_bytes=1).collect()), key=repr) == want
    kept = decontam.clean(odd(spark), b)
    assert kept.columns == odd(spark).columns
    assert sorted(map(repr, (tuple(r)[:2] for r in kept.collect()))) == sorted(repr(x) for x in ODD if not any(x[0] == w[0] and w[5] for w in want))
    assert decontam.clean(odd(spark), b.limit(0)).count() == len(ODD)
    assert decontam.digest(odd(spark).limit(0), b).count() == 0


def exact_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    h = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark, monkeypatch):
    d = read(spark, SF, "documents").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in d.collect()} | {9001: None, 9002: "", 9003: "one two", 9004: "ONE two"}
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    prints = {i: exact_print(t) for i, t in rows.items()}
    want = reach(sorted(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(d).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in rows}
    for size in (simhash.BROADCAST_BYTES, 0):
        monkeypatch.setattr(simhash, "BROADCAST_BYTES", size)
        kept = sorted(r.doc_id for r in simhash.keep_one(d).collect())
        assert kept == sorted(set(want.values()))


def test_fingerprints_of_two_bits_share_a_key(spark):
    rng = random.Random(1)
    prints = []
    for _ in range(300):
        a = rng.getrandbits(64)
        prints += [a, *(a ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 3))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(d).collect()}
    want = {tuple(sorted((a, b), key=signed)) for i, a in enumerate(prints) for b in prints[i + 1:] if 0 < (a ^ b).bit_count() <= 2}
    assert got == want


def test_simhash_of_odd_rows(spark):
    got = simhash.groups(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "4", "5", "6", "None"]
    assert simhash.keep_one(odd(spark).limit(0)).count() == 0


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def near_copies(rng, text, times, share):
    w = text.split()
    for _ in range(times):
        c = w[:]
        for i in rng.sample(range(len(w)), max(1, int(share * len(w)))):
            c[i] = f"new{rng.randrange(10**9)}"
        yield " ".join(c)


@pytest.mark.parametrize("parts", [simhash.SHARE, 8])
def test_similar_documents_stay_once_and_others_stay(spark, monkeypatch, parts):
    """Against all pairs of whole texts: what goes is in a brute-force group with one that stays,
    clean documents stay, and near all pairs of 0.9 or more are found, in large groups too."""
    monkeypatch.setattr(simhash, "SHARE", parts)
    rng = random.Random(3)
    d = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect() if r.text and len(r.text.split()) > 60][:250]
    pairs = [(100_000 + i, t) for i, (_, s) in enumerate(d[:100]) for t in near_copies(rng, s, 1, 0.008)]
    large = [(200_000 + i, t) for i, t in enumerate(near_copies(rng, " ".join(s for _, s in d[100:102]), 150, 0.004))]
    far = [(300_000 + i, t) for i, (_, s) in enumerate(d[110:150]) for t in near_copies(rng, s, 1, 0.2)]
    rows = d + pairs + large + far
    got = {r.doc_id for r in simhash.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: five(t) for i, t in rows}
    want = reach(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    stays = {want[i] for i in got}
    assert stays == set(want.values()) and all(i in got for i in set(want.values()))
    assert {i for i, _ in far} <= got and len({i for i, _ in large} & got) <= 2
    close = [i for i, _ in pairs if want[i] != i]
    assert len(close) > 60 and sum(i not in got for i in close) >= 0.9 * len(close)


def test_verification_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        a = " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))
        b = " ".join(near_copies(rng, a, 1, rng.choice((0, 0.02, 0.1)))) if a and rng.random() < 0.9 else a
        x, y = five(a), five(b)
        assert simhash.are_similar(a.encode(), b.encode()) == (5 * len(x & y) >= 4 * len(x | y))


def test_similar_documents_of_odd_rows(spark):
    kept = simhash.keep_dissimilar(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "4", "5", "6", "None"]
    assert simhash.keep_dissimilar(odd(spark).limit(0)).count() == 0
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words, 1), (1, "other words alone here now", 2), (2, words + " end", 3), (3, "x " * 300_000, 4), (4, "x " * 300_001, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, low long")
    got = simhash.keep_dissimilar(d).collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.doc_id for r in got} in ({1, 3}, {1, 2, 3})


def test_candidates_of_every_similarity_are_found_and_few_by_chance():
    rng = random.Random(11)
    some = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))) for _ in range(1500)]
    copies = [next(near_copies(rng, t, 1, rng.uniform(0.002, 0.025))) for t in some]
    a, b = (simhash.bands([t.encode() for t in x])[1] for x in (some, copies))
    found, by = (a == b).any(1).tolist(), {}
    for s, c, hit in zip(some, copies, found, strict=True):
        x, y = five(s), five(c)
        by.setdefault(int(40 * len(x & y) / len(x | y)), []).append(hit)
    assert all(np.mean(by[step]) >= 0.95 for step in range(32, 39)) and min(len(by[step]) for step in range(32, 39)) > 30
    assert len(np.unique(a)) == a.size


def test_shingles_are_counted_and_short_texts_have_no_keys():
    some = ["", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 300_000]
    size, keys = simhash.bands([t.encode() for t in some])
    assert size.tolist() == [0, 0, 1, 5, 1] and len(keys) == 3 and len(np.unique(keys)) == keys.size


def test_chains_are_one_group_whatever_is_merged_first(spark):
    """The third text is similar to the second alone, which goes with the first; the fourth to the third."""
    words = [f"w{i}" for i in range(400)]
    steps = [words[i:] + [f"n{j}" for j in range(i)] for i in (0, 30, 60, 90)]
    rows = [(i, " ".join(w)) for i, w in enumerate(steps)] + [(9, " ".join(f"z{i}" for i in range(400)))]
    sets = {i: five(t) for i, t in rows}
    want = set(reach(sorted(sets), lambda a, b: alike(sets[a], sets[b])).values())
    assert want == {0, 9} and not alike(sets[0], sets[2]) and not alike(sets[1], sets[3])
    for order in (lambda i: i, lambda i: 9 - i, lambda i: (0, 3, 1, 2)[i] if i < 4 else i):
        d = spark.createDataFrame([(order(i), t) for i, t in rows], "doc_id long, text string")
        assert {r.doc_id for r in simhash.keep_dissimilar(d).collect()} == {min(map(order, range(4))), order(9)}


@pytest.mark.parametrize("parts", [simhash.SHARE, 8])
def test_nodes_of_one_component_are_not_paired(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "SHARE", parts)
    rows = [(i, 100, [1, 2], 0) for i in range(300)] + [(i, 100 if i % 2 else 130, [2], i) for i in range(300, 330)]
    got = simhash.other_pairs(spark.createDataFrame(rows, "node long, size long, keys array<long>, component long"))
    odd_ones = range(301, 330, 2)
    want = {(i, j) for i in odd_ones for j in [*range(300), *odd_ones] if j < i} | {(i, j) for i in range(300, 330, 2) for j in range(300, i, 2)}
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    assert simhash.other_pairs(spark.createDataFrame(rows[:300], "node long, size long, keys array<long>, component long")).count() == 0


@pytest.mark.parametrize("parts", [simhash.SHARE, 8])
def test_texts_with_a_passage_in_common_are_not_paired(spark, monkeypatch, parts):
    """A passage that is over half of many dissimilar texts gives them bands in common; those that it makes
    similar, and near copies among the others, are found all the same."""
    monkeypatch.setattr(simhash, "SHARE", parts)
    rng, seen, verified = random.Random(13), [], simhash.verified
    passage = " ".join(f"p{i}" for i in range(200))
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    far = [f"{passage} {own(100)}" for _ in range(600)]
    close = [f"{passage} {own(10)}" for _ in range(30)]
    copies = [c for t in far[:60] for c in near_copies(rng, t, 2, 0.004)]
    rows = list(enumerate(far + close + copies))
    rng.shuffle(rows)

    def spy(pairs, docs):
        seen.append(pairs.count())
        return verified(pairs, docs)

    monkeypatch.setattr(simhash, "verified", spy)
    got = {r.doc_id for r in simhash.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: five(t) for i, t in rows}
    assert got == set(reach(sorted(sets), lambda a, b: alike(sets[a], sets[b])).values()) and len(got) == 601
    assert sum(seen) < 5 * len(rows), seen


def test_similar_texts_that_share_no_band_are_one_group(spark):
    """Bands miss some pairs of 0.8; each one here is such a pair, in texts of several lengths."""
    rng, rows = random.Random(19), []
    while len(rows) < 12:
        t = " ".join(f"w{rng.randrange(10**6)}" for _ in range((60, 130, 600)[len(rows) // 2 % 3]))
        words = t.split()
        c = " ".join(words[:-max(1, len(words) // 10)] + [f"n{rng.randrange(10**6)}" for _ in range(len(words) // 10)])
        a, b = simhash.bands([t.encode(), c.encode()])[1]
        if alike(five(t), five(c)) and not (a == b).any():
            rows += [(len(rows), t), (len(rows) + 1, c)]
    got = simhash.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(0, 12, 2))


def test_least_hashes_leave_no_similar_pair_out(spark):
    """Sets of all sizes, one within the other or crossing: what is similar is left apart; texts with a short
    passage in common are not."""
    rng, rows = random.Random(23), []
    for n in [*range(5, 60), *range(60, 400, 17)]:
        w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        rows += [" ".join(w), " ".join(w[:max(5, int((n - 4) * 0.8) + 4)]), " ".join(w[n // 3:] + [f"v{i}.{n}" for i in range(n)])]
        rows += list(near_copies(rng, " ".join(w), 1, 0.02))
    far = range(len(rows), len(rows) + 100)
    rows += [" ".join([*(f"p{j}" for j in range(20)), *(f"f{i}.{j}" for j in range(80))]) for i in far]
    rows = list(enumerate(rows))
    sets = {i: five(t) for i, t in rows}
    nodes = spark.createDataFrame([(i, len(x), i) for i, x in sets.items()], "node long, size long, component long")
    got = {r.node for r in simhash.left_apart(nodes, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = {k for i in sets for j in sets if i < j and alike(sets[i], sets[j]) for k in (i, j)}
    assert len(similar) > 80 and similar <= got and not got & set(far)
    one = nodes.withColumn("component", nodes.node * 0)
    assert simhash.left_apart(one, spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [simhash.SHARE, 8])
def test_rarest_shingles_find_every_similar_pair(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "SHARE", parts)
    rng = random.Random(17)
    passages = [" ".join(f"p{i}.{j}" for j in range(rng.randrange(8, 60))) for i in range(12)]
    some = [" ".join(rng.choice(passages) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    rows = list(enumerate(some + [next(near_copies(rng, t, 1, rng.choice((0.001, 0.02)))) for t in some] + ["a b c d", "", "a b c d e", "a b c d e a b c d e"]))
    sets = {i: five(t) for i, t in rows if len(t.split()) > 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = spark.createDataFrame([(i, len(x), i % 100) for i, x in sets.items()], "node long, size long, component long")
    got = {tuple(r) for r in simhash.other_pairs(simhash.rarest(nodes, docs)).collect()}
    want = {(i, j) for i in sets for j in sets if j < i and i % 100 != j % 100 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 150 and want <= got and all(i % 100 != j % 100 for i, j in got)


def test_license_base_equals_brute_force(spark):
    d = read(spark, SF, "documents").select("doc_id", "text")
    extra = [(9000 + i, t) for i, (_, t) in enumerate(ODD)] + [(9100, "cc by CC-BY, cc by General Public License all rights reserved reserved"), (9101, "Released under the MIT license."), (9102, "licensed under the very Apache License, Version 2.0")]
    rows = [(r.doc_id, r.text) for r in d.collect()] + extra
    got = {r.doc_id: r for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w, at = words(t), []
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at += [(k, label) for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        r = got[i]
        assert tuple(r)[1:6] == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[9101].labels == "mit" and got[9101].score == 1 and got[9102].labels == "apache-2.0"
    assert licenses.digest(odd(spark)).count() == len(ODD) and licenses.digest(odd(spark).limit(0)).count() == 0


def exact_labels(text):
    """Labels, and the largest cover, of notices on any band of diagonals, one by one."""
    w, out, score = words(text), set(), 0.0
    for phrase, label, exact in [(*x, True) for x in licenses.BASE] + [(*x, False) for x in licenses.NOTICES]:
        p = phrase.split()
        k = min(licenses.K, len(p))
        at = {}
        for i in range(len(p) - k + 1):
            at.setdefault(tuple(p[i:i + k]), []).append(i)
        places = {}
        for i in range(len(w) - k + 1):
            for j in at.get(tuple(w[i:i + k]), ()):
                places.setdefault(i - j, set()).add(j)
        for d in places:
            near = set().union(*(places.get(e, set()) for e in range(d - licenses.BAND, d + licenses.BAND + 1)))
            cover = len({x for j in near for x in range(j, j + k)}) / len(p)
            score = max(score, cover)
            if exact and len(places[d]) == len(p) - k + 1 or not exact and cover >= licenses.COVER:
                out.add(label)
    return ",".join(sorted(out)), score


def test_license_labels_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    for n, (notice, _) in enumerate(licenses.NOTICES):
        for m, edits in enumerate((0, 1, 3, 8, 20)):
            w = notice.split()
            for _ in range(min(edits, len(w) - 2)):
                i = rng.randrange(max(1, len(w)))
                w[i:i + rng.choice((0, 1, 2))] = rng.choice(([], ["new"], ["two", "more"]))
            rows.append((9000 + 10 * n + m, " ".join([*words(rows[n][1]), *w, "and the rest."])))
    rows.append((8000, "the software is provided as is " * 2000))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i] == exact_labels(text)
    assert {x for labels, _ in got.values() for x in labels.split(",")} >= {label for _, label in licenses.NOTICES}


def test_license_spans_are_bounded(spark):
    texts = ["x y " * 30 + notice + " z" for notice, _ in licenses.NOTICES] + ["permission is hereby granted free of charge " * 50]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        size = max(len(notice.split()) for notice, _ in licenses.NOTICES)
        assert all(s.last - s.first + 1 <= size + 2 * licenses.BAND and s.first >= -licenses.BAND for s in r.spans)
        if r.doc_id < len(licenses.NOTICES):
            notice, label = licenses.NOTICES[r.doc_id]
            assert (label, 60, 59 + len(notice.split()), 1.0) in [tuple(s) for s in r.spans]


def test_license_spans_hold_the_notice(spark):
    d = spark.createDataFrame([(1, "a b c. Released under the MIT License. d e")], "doc_id long, text string")
    spans = licenses.scan(d).first().spans
    assert ("mit", 3, 7, 1.0) in [tuple(s) for s in spans] and {s.label for s in spans} == {"mit"}


def brute_vectors(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v in ok}
    near = lambda a, b: len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ids = sorted(unit)
    return {i: sum(near(i, j) for j in ids if j != i) for i in ids}, reach(ids, near)


def test_embedding_near_dups_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    tight = x[0] + 0.03 * rng.normal(size=(200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, tight, x[5:6].repeat(30, 0), x[9:10] * 7, x[9:10] * 1e-3]))]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (n + 4, []), (n + 5, [float("inf")] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    links, comp = brute_vectors(rows)
    got = {r.vec_id: r for r in vector_dedup.near_dups(v).collect()}
    assert len(got) == len(rows)
    found, exact = sum(got[i].n_links for i in links), sum(links.values())
    assert found <= exact and found >= 0.99 * exact
    assert all(got[i].n_links <= links.get(i, 0) for i in got)
    assert {i: got[i].component_id for i in comp} == comp
    for i in range(n, n + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vector_dedup.near_dups(v.limit(0)).count() == 0


def test_embedding_recall_over_a_whole_table(spark):
    v = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    x = vector_dedup.unit([e for _, e in rows])
    exact = dict(zip([i for i, _ in rows], ((x @ x.T >= 0.95).sum(1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in vector_dedup.near_dups(v).collect()}
    assert all(got[i] <= exact[i] for i in exact) and sum(got.values()) >= 0.9 * sum(exact.values())


def isolated_pairs(rng, pairs, singles, low, high):
    x = vector_dedup.unit(rng.normal(size=(pairs + singles, 64)))
    u = rng.normal(size=(pairs, 64))
    u = vector_dedup.unit(u - (u * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    cos = rng.uniform(low, high, size=(pairs, 1))
    return np.concatenate([x, cos * x[:pairs] + np.sqrt(1 - cos**2) * u])


def test_isolated_pairs_are_found_under_hundreds_of_centres(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", 16)
    monkeypatch.setattr(vector_dedup, "SAMPLE_BYTES", 8 * 64 * 2400)  # as of a large table, most pairs are not in the sample
    rng = np.random.default_rng(4)
    x = isolated_pairs(rng, 1500, 3000, 0.951, 0.953)
    few = len(x)
    x = np.concatenate([x, vector_dedup.unit(rng.normal(size=(1, 64)) + 0.01 * rng.normal(size=(300, 64)))])
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    n = {r.vec_id: r.n_links for r in vector_dedup.near_dups(v).collect()}
    exact = (x @ x.T >= 0.95).sum(1) - 1
    assert all(n[i] <= exact[i] for i in n)
    assert sum(n[i] for i in range(few)) >= 0.99 * exact[:few].sum()


def test_hot_cells_are_searched_in_blocks(spark, monkeypatch):
    """A wide cluster that no cells can part, cut into blocks, and near copies of one vector."""
    monkeypatch.setattr(vector_dedup, "CAP", 300)
    monkeypatch.setattr(vector_dedup, "CELL", 400)
    rng = np.random.default_rng(7)
    wide = vector_dedup.unit(rng.normal(size=(1, 32)) + 0.045 * rng.normal(size=(1200, 32)))
    x = np.concatenate([wide, vector_dedup.unit(rng.normal(size=(1, 32)) + 1e-4 * rng.normal(size=(600, 32))), isolated_pairs(rng, 100, 200, 0.951, 0.99)[:, :32]])
    x = vector_dedup.unit(x)
    v = spark.createDataFrame([(i, e.tolist(), "clash") for i, e in enumerate(x)], "vec_id long, embedding array<double>, cell string").repartition(4)
    rows = {r.vec_id: r for r in vector_dedup.near_dups(v).collect()}
    near = x @ x.T >= 0.95
    exact = near.sum(1) - 1
    assert all(rows[i].n_links <= exact[i] for i in rows) and sum(r.n_links for r in rows.values()) >= 0.98 * exact.sum()
    assert {i: r.component_id for i, r in rows.items()} == reach(list(range(len(x))), lambda a, b: near[a, b])


def test_graph_search_finds_what_is_in_range():
    """From the medoids alone too, among clusters of all widths, one of them around a tighter one."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(8, 48))
    x = np.concatenate([rng.normal(size=(1500, 48)), *(b + w * rng.normal(size=(250, 48)) for b, w in zip(base, np.geomspace(1e-3, 0.3, 8), strict=True)), base[4] + 1e-3 * rng.normal(size=(40, 48))])
    x = vector_dedup.unit(x)[rng.permutation(len(x))].astype(np.float32)
    lists, medoids = vector_dedup.graph(x, rng)
    assert lists.shape == (len(x), vector_dedup.DEGREE) and (lists < len(x)).all() and (lists != np.arange(len(x))[:, None]).all()
    want = (x @ x.T >= 0.95).sum()
    for own in (None, np.arange(len(x))):
        a, b = vector_dedup.search(x, x, lists, medoids, own)
        assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a) and len(a) >= 0.98 * want
        assert (np.einsum("ij,ij->i", x[a], x[b]) >= 0.9498).all()


def test_groups_of_pairs_equal_brute_force():
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 400, (2, 300))
    label = vector_dedup.joined(vector_dedup.joined(np.arange(400), a[:150], b[:150]), a[150:], b[150:])
    linked = {(int(i), int(j)) for i, j in zip(a, b, strict=True)}
    assert dict(enumerate(label.tolist())) == reach(list(range(400)), lambda i, j: (i, j) in linked or (j, i) in linked)


def test_audit_is_not_drowned_by_a_dense_group(spark):
    rng = np.random.default_rng(5)
    group = vector_dedup.unit(rng.normal(size=(1, 64)) + 0.01 * rng.normal(size=(200, 64)))
    x = np.concatenate([group, isolated_pairs(rng, 50, 0, 0.96, 0.99)])
    classes = spark.createDataFrame([(i, i, i, 1, e.tolist()) for i, e in enumerate(x)], "node long, h1 long, h2 long, n long, embedding array<double>")
    counted = spark.createDataFrame([(i, 199) for i in range(200)], "node long, links long")
    assert abs(vector_dedup.audited(classes, counted) - 200 / 300) < 1e-6


def test_comparing_all_pairs_takes_over_when_the_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", 8 * 64 * 50)
    monkeypatch.setattr(vector_dedup, "linked", lambda members: members.selectExpr("node a", "node b", "cast(null as long) n").limit(0))
    x = isolated_pairs(np.random.default_rng(6), 60, 30, 0.96, 0.99)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    rows = vector_dedup.near_dups(v).collect()
    assert sum(r.n_links for r in rows) == 120 and sum(r.kept for r in rows) == 90
