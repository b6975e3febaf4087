import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from visret.functions import parse
from visret.operators import ann, candidates, curate, encode, evaluate, exact, ordering, rerank


def parsed(spark, text):
    return rerank.parsed_queries(spark.createDataFrame([("q", text)], "query_id string, text string")).first()


def test_parser_binds_colours_to_garments(spark):
    p = parsed(spark, "A red tie and a white shirt in a formal setting.")
    assert p.bindings == ["red tie", "white shirt"] and "formal setting" in p.scenes and "formal outfit" in p.styles
    p = parsed(spark, "Someone wearing a blue shirt sitting on a park bench.")
    assert (p.bindings, p.scenes, p.actions) == (["blue shirt"], ["park"], ["sitting"])
    assert parsed(spark, "A person in a bright  yellow\traincoat.").bindings == ["bright yellow raincoat"]
    assert parsed(spark, "no red tie, please").negatives == ["red tie"]
    p = parsed(spark, None)
    assert not (p.bindings or p.scenes or p.styles or p.actions or p.negatives)


def test_counterfactuals(spark):
    row = spark.range(1).select(
        parse.color_of(F.lit("bright yellow raincoat")).alias("c"), parse.garment_of(F.lit("bright yellow raincoat")).alias("g"),
        parse.distractors(F.lit("red"), F.lit("tie"), F.array(F.lit("red"), F.lit("white"))).alias("d")).first()
    assert (row.c, row.g) == ("yellow", "raincoat") and {"red shirt", "red pants", "white tie"} <= set(row.d)


def test_soft_min_and_standardised(spark):
    z = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 2.0), (2, -1.0)], "i int, z double")
    got = {r.i: r.s for r in z.groupBy("i").agg(rerank.soft_min(F.col("z")).alias("s")).collect()}
    assert got[1] > got[2] and abs(got[1] - 1) < 1e-9
    flat = spark.createDataFrame([(1, 1.0)] * 4, "i int, x double").select(rerank.standardized(F.col("x"), "i").alias("z"))
    assert {r.z for r in flat.collect()} == {0.0}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_top_k_equals_brute_force(spark, parts):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 8))
    x[40:50] = x[3]  # ties
    x[60] = 0
    images = spark.createDataFrame([(f"{i:03}", x[i].tolist()) for i in range(80)], "image_id string, embedding array<double>").repartition(parts)
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in (3, 7, 60)], "query_id long, vec array<double>")
    got = candidates.top_k(images, queries, 6, block_bytes=100).orderBy("query_id", "cand_rank").collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in (3, 7, 60):
        want = sorted(range(80), key=lambda i: (-round(float(u[q] @ u[i]), 12), i))[:6]
        assert [int(r.image_id) for r in got if r.query_id == q] == want
    assert candidates.top_k(images, queries, 500).count() == 240
    assert candidates.top_k(images, queries.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        candidates.top_k(images, queries, 0)


def clustered(rng, groups, each, width, noise):
    base = rng.normal(size=(groups, width))
    return np.concatenate([base + noise * rng.normal(size=base.shape) for _ in range(each)])


def searched(spark, path, images, queries, k):
    codes, index = ann.load(spark, path)
    return index, {(r.query_id, r.image_id): r.cosine for r in ann.search(codes, index, images, queries, k).collect()}


def best(images, queries, k):
    return {(r.query_id, r.image_id): r.cosine for r in candidates.top_k(images, queries, k).collect()}


def test_approximate_search_over_a_stored_index_of_clusters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(candidates, "CELL", 40)
    rng = np.random.default_rng(1)
    x = clustered(rng, 60, 50, 24, 0.2)
    x = np.concatenate([x, x[:1] + 0.01 * rng.normal(size=(1500, 24))])  # a hot cell
    images = spark.createDataFrame([(f"{i:04}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0])], "image_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 30)] + [(-1, [1.0])], "query_id int, vec array<double>")
    path = str(tmp_path / "ann")
    ann.write(images, path)
    index, found = searched(spark, path, images, queries, 5)
    true = best(images, queries.where("query_id >= 0"), 5)
    assert len(found) == 500 and len(true.keys() & found.keys()) >= 0.9 * len(true)
    assert all(abs(found[p] - true[p]) < 1e-12 for p in true.keys() & found.keys())
    assert index.images == 4500
    assert index.probes < 0.2 * len(index.cells) and ann.depth_for(index, 5) < 0.1 * 4500
    monkeypatch.setattr(ann, "TABLE_BYTES", 5 * 4 * 256 * 6)  # several blocks of queries
    assert searched(spark, path, images, queries, 5)[1] == found
    assert searched(spark, path, images, queries.limit(0), 5)[1] == {}
    with pytest.raises(ValueError, match="positive"):
        searched(spark, path, images, queries, 0)
    with pytest.raises(ValueError, match="no vectors"):
        ann.write(images.where("image_id = 'null'"), path)


def test_approximate_search_where_nothing_is_clustered(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    images = spark.createDataFrame([(f"{i:04}", v.tolist()) for i, v in enumerate(x)], "image_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(100)], "query_id int, vec array<double>")
    ann.write(images, str(tmp_path / "ann"))
    index, found = searched(spark, str(tmp_path / "ann"), images, queries, 10)
    true = best(images, queries, 10)
    assert len(true.keys() & found.keys()) >= 0.9 * len(true) and ann.depth_for(index, 10) < 0.1 * 2000


def test_exact_search_skips_cells_and_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(candidates, "CELL", 40)
    rng = np.random.default_rng(1)
    x = clustered(rng, 40, 50, 24, 0.1)
    x[7] = x[8] = 0
    rows = [(f"{i:04}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0]), ("short2", [-1.0])]
    images = spark.createDataFrame(rows, "image_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 3, 7, *range(100, 160))] + [(-1, [2.0]), (-2, [1.0, 2.0])], "query_id int, vec array<double>")
    exact.write(images, str(tmp_path / "cells"))
    vectors, cells = exact.load(spark, str(tmp_path / "cells"))
    for k in (1, 5, 2000):
        want = sorted(map(tuple, candidates.top_k(images, queries, k).collect()))
        assert sorted(map(tuple, exact.search(vectors, cells, queries, k).collect())) == want
    q = candidates.unit_rows(x[100:160])
    first = cells.nearest(q, 5)
    floor = -np.sort(-(q @ candidates.unit_rows(x).T), axis=1)[:, 4]
    looked = ((first | cells.others(q, first, floor)) * cells.images).sum()
    assert looked < 0.3 * len(q) * len(x)
    assert sorted(map(tuple, exact.search(vectors, cells, queries, 5, block_bytes=200).collect())) == sorted(map(tuple, candidates.top_k(images, queries, 5).collect()))
    assert exact.search(vectors, cells, queries.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        exact.search(vectors, cells, queries, 0)


def test_codes_are_the_nearest_centres():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6))
    index = ann.Index(np.zeros((1, 6)), [rng.normal(size=(9, 4)), rng.normal(size=(3, 2))], 1, 1.0, 50)
    codes, tables = index.codes(x), index.tables(x[:7])
    for i in range(50):
        assert codes[i].tolist() == [min(range(len(b)), key=lambda c: ((p - b[c]) ** 2).sum()) for p, b in zip((x[i, :4], x[i, 4:]), index.books, strict=True)]
    whole = np.concatenate([index.books[0][codes[:, 0]], index.books[1][codes[:, 1]]], axis=1)
    assert np.allclose(x[:7] @ whole.T, tables[:, 0][:, codes[:, 0]] + tables[:, 1][:, codes[:, 1]])


@pytest.mark.parametrize("rows", [candidates.AT_ONCE, 50])
def test_region_max_equals_brute_force(spark, monkeypatch, rows):
    """Ids that hold any character, an image of very many regions, regions in several tasks."""
    monkeypatch.setattr(candidates, "AT_ONCE", rows)
    rng = np.random.default_rng(3)
    names = ["a#1", "a#2", "a", "#", "", *map(str, range(20))] + ["many"] * 300
    x = rng.normal(size=(len(names) * 3, 6))
    regions = [(names[i % len(names)], i, x[i].tolist()) for i in range(len(x))]
    queries = [(i, rng.normal(size=6)) for i in range(4)]
    got = candidates.region_max(spark.createDataFrame(regions, "image_id string, region_no int, embedding array<double>").repartition(5),
                                spark.createDataFrame([(i, q.tolist()) for i, q in queries], "query_id int, vec array<double>"), 7).collect()
    for i, q in queries:
        best = {}
        for name, _, v in regions:
            best[name] = max(best.get(name, -2), round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 12))
        want = sorted(best, key=lambda n: (-best[n], n))[:7]
        assert [r.image_id for r in sorted(got, key=lambda r: r.cand_rank) if r.query_id == i] == want


def test_numbers_and_medians_of_a_hot_group(spark):
    from visret.operators import ordering

    rng = np.random.default_rng(4)
    rows = [(int(k), float(v), str(i)) for i, (k, v) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3], 999), rng.integers(0, 50, 999), strict=True))]
    d = spark.createDataFrame([*rows, (4, None, "x"), (5, 2.5, "y")], "k int, v double, id string").repartition(6)
    got = {r.id: r.n for r in ordering.numbered(d.where("v is not null"), ["k"], [F.desc("v"), F.asc("id")], "n").collect()}
    for k in (1, 2, 3):
        assert [got[i] for _, i in sorted((-v, i) for kk, v, i in rows if kk == k)] == list(range(1, sum(kk == k for kk, *_ in rows) + 1))
    middle = {r.k: r.m for r in ordering.medians(d, ["k"], "v", "m").collect()}
    assert middle == {**{k: float(np.median([v for kk, v, _ in rows if kk == k])) for k in (1, 2, 3)}, 5: 2.5}


def test_quota_allocation(spark):
    s = spark.createDataFrame([(f"{i}", f, x) for i, row in enumerate([(1.0, 1.0), (0.9, 0.8), (0.8, 0.9), (0.7, 0.7)]) for f, x in enumerate(row)], "image_id string, facet_no long, score double")
    facets = spark.createDataFrame([(0, 2), (1, 2)], "facet_no long, quota int")
    picks = curate.allocated(s, facets).orderBy("pick_no").collect()
    assert len({p.image_id for p in picks}) == 4 and [p.facet_no for p in picks] == [0, 1, 0, 1]
    assert [(p.image_id, p.rank) for p in picks] == [("0", 1), ("2", 2), ("1", 2), ("3", 4)]
    with pytest.raises(ValueError, match="needed"):
        curate.allocated(s.where("image_id < '3'"), facets)
    assert sum(f[3] for f in curate.COVERAGE) == 1000


def serial(ranks, quotas):
    used, out = set(), []
    for turn in range(max(quotas.values())):
        for f, quota in quotas.items():
            if turn < quota:
                rank, image = next((i + 1, x) for i, x in enumerate(ranks[f]) if x not in used)
                used.add(image)
                out.append((len(out) + 1, image, f, rank))
    return out


@pytest.mark.parametrize("alike", [0.0, 0.9])
def test_allocation_in_runs_equals_turn_by_turn(spark, alike):
    rng = np.random.default_rng(6)
    base = rng.normal(size=200)
    quotas = {0: 30, 1: 7, 3: 45, 4: 0, 9: 12}
    scores = {f: np.round(alike * base + (1 - alike) * rng.normal(size=200), 1) for f in quotas}
    rows = [(f"{i:03}", f, float(s)) for f, own in scores.items() for i, s in enumerate(own)]
    s = spark.createDataFrame(rows, "image_id string, facet_no long, score double").repartition(3)
    facets = spark.createDataFrame(list(quotas.items()), "facet_no long, quota int")
    want = serial({f: [f"{i:03}" for i in np.lexsort((np.arange(200), -own))] for f, own in scores.items()}, quotas)
    for at_once in (1 << 21, 100, 1):
        got = curate.allocated(s, facets, at_once=at_once).select("pick_no", "image_id", "facet_no", "rank").orderBy("pick_no").collect()
        assert list(map(tuple, got)) == want
    for quotas_, most in (([3, 1, 3], 2), ([5], 100), ([0, 2], 1)):
        runs = list(curate.turns(quotas_, most))
        assert [a for a, _, _ in runs] == [0, *[b for _, b, _ in runs[:-1]]] and runs[-1][1] == max(quotas_) and sum(n for *_, n in runs) == sum(quotas_)
    million = list(curate.turns([1_000_000] * 18, curate.AT_ONCE // 18))
    assert max(n for *_, n in million) * 18 <= curate.AT_ONCE and len(million) < 200


def test_medians_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"a": [1.0], "b": [1.0, 2.0], "c": [-1e308, 1e308, 1e308], "d": [inf, -inf, 0.0], "e": [nan, nan, 3.0], "f": [inf, 5.0], "g": [None, None], "h": [0.0] * 9999 + [1e300], "i": [5e-324, 0.0, -5e-324, 1.0],
              "j": np.random.default_rng(8).lognormal(0, 9, 20_001).tolist(), "k": [None, 4.0, 2.0]}
    d = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double").repartition(5)
    got = {r.k: r.m for r in ordering.medians(d, ["k"], "v", "m").collect()}
    for k, own in groups.items():
        some = sorted((v for v in own if v is not None), key=lambda v: (v != v, v))
        if not some:
            assert k not in got
            continue
        low, high = some[(len(some) - 1) // 2], some[len(some) // 2]
        want = low if low == high else (low + high) / 2
        assert got[k] == want or (want != want and got[k] != got[k]), k



def test_metrics_without_relevant_images(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "query_id int, rank int, image_id string")
    relevant = spark.createDataFrame([(1, "b"), (1, "c")], "query_id int, image_id string")
    got = {r.query_id: (r.reciprocal_rank, r.recall, round(r.ndcg, 6)) for r in evaluate.metrics(ranked, relevant, 10).collect()}
    assert got == {1: (0.5, 0.5, round((1 / np.log2(3)) / (1 + 1 / np.log2(3)), 6)), 2: (0.0, 0.0, 0.0)}
    with pytest.raises(ValueError, match="no relevant"):
        evaluate.validated(spark.createDataFrame([("q", [])], "query string, relevant_image_ids array<string>"))


def test_ragged_regions_have_no_padding(spark):
    """An image with fewer regions than others can have a negative margin."""
    images = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "image_id string, embedding array<double>")
    crops = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [0.0, 1.0])], "image_id string, region_no int, embedding array<double>")
    v = spark.createDataFrame([(1, 1, "binding", "red tie", r, 0, x) for r, x in (("phrase", [1.0, 0.0]), ("garment", [1.0, 0.0]), ("distractor", [0.0, 1.0]))],
                              "query_id int, facet_no int, kind string, facet string, role string, role_no int, vec array<double>")
    c = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 2, 0.0)], "query_id int, image_id string, cand_rank int, cosine double")
    got = {r.image_id: r.margin for r in rerank.evidence(c, images, crops, v).collect()}
    assert got == {"a": 1.0, "b": -1.0}


def test_backfill_encodes_what_is_missing(spark):
    catalog = spark.createDataFrame([("a",), ("b",)], "path string")
    cached = spark.createDataFrame([("a", "m", [1.0]), ("b", "old", [5.0]), ("gone", "m", [9.0])], "path string, model_id string, embedding array<double>")
    asked = []

    def coded(d):
        asked.extend(r.path for r in d.collect())
        return d.withColumn("embedding", F.array(F.lit(2.0)))

    got = {r.path: r.embedding for r in encode.backfilled(catalog, cached, "m", coded).collect()}
    assert got == {"a": [1.0], "b": [2.0]} and asked == ["b"]


def test_settings_of_the_session_stay_as_they_are(spark):
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    s = spark.createDataFrame([(str(i), i % 2, float(i)) for i in range(30)], "image_id string, facet_no int, score double")
    assert curate.rankings(s, 1500).count() == 30 and curate.rankings(s, 3).count() == 6
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before


def test_comparison_of_strategies(spark):
    run = lambda ids: spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ids)], "query_id int, rank int, image_id string")
    r = evaluate.comparison(run("cab"), run("abcd"), 2).first()
    assert (r.image_id, r.baseline_rank, r.structured_top, r.baseline_top) == ("c", 3, ["c", "a"], ["a", "b"])


@pytest.mark.parametrize("one_each", [False, True])
def test_rows_that_wait_for_the_best_are_bounded(monkeypatch, one_each):
    """By queries and k, not by the images seen, here in an order where each is better than all before."""
    monkeypatch.setattr(candidates, "WAITING", 64)
    rng = np.random.default_rng(9)
    q, x = candidates.unit_rows(rng.normal(size=(20, 6))), candidates.unit_rows(rng.normal(size=(4000, 6)))
    x = x[np.argsort((q @ x.T).max(0))]
    ids = [f"{i // 2 if one_each else i:04}" for i in range(4000)]
    held, most = candidates.Best(q, 5, one_each), 0
    for i in range(0, 4000, 25):
        held.look(pa.array(ids[i:i + 25]), x[i:i + 25])
        most = max(most, sum(len(r[0]) for r in held.rows))
    assert most <= 20 * 5 + 100 + 20 * 25
    got = [tuple(r.values()) for b in held.found(list(range(20)), pa.int64()) for r in b.to_pylist()]
    for n in range(20):
        best = {}
        for name, s in zip(ids, np.round(q[n] @ x.T, 12).tolist(), strict=True):
            best[name] = max(best.get(name, -2), s)
        want = sorted(((n, name, s) for name, s in best.items()), key=lambda r: (-r[2], r[1]))[:5]
        assert [r[:2] for r in got if r[0] == n] == [r[:2] for r in want]


def test_metrics_by_label_equal_those_of_pairs(spark):
    images = [("a", 1), ("b", 1), ("c", 2), ("d", None), ("e", 1), ("e", 1), ("f", 3)]
    queries = [(1, "a", 1), (2, "c", 2), (3, "d", None), (4, "x", 1), (5, "f", 4)]
    pairs = [(q, i) for q, own, of in queries for i, label in images if of is not None and label == of and i != own]
    ranked = spark.createDataFrame([(q, n + 1, i) for q in range(1, 7) for n, i in enumerate("bacdef")], "query_id int, rank int, image_id string")
    labels = spark.createDataFrame(images, "image_id string, label int")
    asked = spark.createDataFrame(queries, "query_id int, own string, label int")
    got = evaluate.metrics_by_label(ranked, labels, asked, 3)
    want = evaluate.metrics(ranked, spark.createDataFrame(pairs, "query_id int, image_id string"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_queries_share_facets_and_vectors_of_a_block(spark, monkeypatch):
    v = spark.createDataFrame([(q, 1, "binding", "red tie", r, 0, x) for q in range(50) for r, x in (("phrase", [1.0, 0.0]), ("garment", [3.0, 4.0]), ("distractor", [0.0, 1.0]))],
                              "query_id int, facet_no int, kind string, facet string, role string, role_no int, vec array<double>")
    (block,) = rerank.role_blocks(v, 4000)  # 50 queries of 3 vectors each
    assert len(block.keys) == 50 and len(block.facets) == 1 and block.roles.shape == (3, 2)
    images = spark.createDataFrame([(f"{i}", [1.0, float(i)]) for i in range(4)], "image_id string, embedding array<double>")
    c = spark.createDataFrame([(q, f"{i}") for q in range(50) for i in range(4)], "query_id int, image_id string")
    got = {(r.query_id, r.image_id): (round(r.phrase, 9), round(r.margin, 9)) for r in rerank.evidence(c, images, images, v, block_bytes=700).collect()}
    assert len(got) == 200 and all(got[q, f"{i}"] == (round(1 / np.hypot(1, i), 9), round((1 - i) / np.hypot(1, i), 9)) for q, i in [(0, 0), (7, 1), (49, 3)])


def test_texts_are_normalized_once_and_phrases_looked_for_first(spark):
    d = spark.createDataFrame([(0, "In a PARK, park-side"), (1, "parking"), (2, None), (3, "éparké car park.")], "query_id int, text string")
    plan = rerank.parsed_queries(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(regexp_replace(lower(") == 1
    found = d.select("query_id", parse.contains(F.lower("text"), "park").alias("p")).collect()
    assert {r.query_id: r.p for r in found} == {0: True, 1: False, 2: None, 3: True}
    made = spark.createDataFrame([(r"a $1 \ {} tie",)], "f string").select(parse.prompts(F.col("f"), "binding").alias("p")).first().p
    assert all(r"a $1 \ {} tie" in p for p in made)
