"""What the physical plans must look like at scale."""

from pyspark.sql import functions as F

from visret.operators import candidates, curate, evaluate

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def images(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("image_id"), "embedding")


def test_candidates_are_limited_before_the_shuffle(spark):
    q = images(spark).limit(3).select(F.col("image_id").alias("query_id"), F.col("embedding").alias("vec"))
    text = plan(candidates.top_k(images(spark), q, 10))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1 and "ReadSchema: struct<vec_id:bigint,embedding" in text


def windows(text):
    return [line for line in text.splitlines() if " Window " in line or "Window [" in line]


def test_no_facet_is_ranked_or_halved_in_one_task(spark):
    s = images(spark).selectExpr("image_id", "cast(image_id as long) % 3 as facet_no", "cast(embedding[0] as double) as score")
    text = plan(curate.rankings(s))
    assert all("part" in line for line in windows(text)) and windows(text)
    report = plan(curate.report(s, s.select("facet_no").distinct()))
    summary = plan(evaluate.time_summary(s, ["facet_no"], "score"))
    assert not any(f in text for text in (report, summary) for f in ("median(", "percentile("))


def test_scores_of_hot_groups_are_standardised_without_a_window(spark):
    from visret import queries

    assert not windows(plan(queries.standardize_scores(spark, SF)))


def test_scans_read_only_what_is_needed(spark):
    from visret import queries

    text = plan(queries.image_ids(spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "html" not in text


def test_a_stored_index_is_joined_where_it_is(spark, tmp_path):
    from visret import queries
    from visret.operators import rerank
    from visret.sources import store

    store.write(*queries.index(spark, SF), str(tmp_path), "lookup")
    index, crops, _ = store.load(spark, str(tmp_path), "lookup")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = plan(index.select("image_id", "embedding").join(crops.select("image_id", "region_no"), "image_id"))
        assert "Exchange" not in both and both.count("Bucketed: true") == 2
        found = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id as query_id", "cast(label as string) as image_id")
        roles = spark.createDataFrame([(q, 1, "binding", "x", r, 0, [0.1] * 64) for q in range(3) for r in ("phrase", "garment")],
                                      "query_id long, facet_no int, kind string, facet string, role string, role_no int, vec array<double>")
        text = plan(rerank.evidence(found, index, crops, roles))
        assert text.count("Bucketed: true") == 2
        for line in text.splitlines():  # what is shuffled are ids and scores
            assert "Exchange" not in line or "embedding" not in line
        below = [lines for lines in text.split("Exchange")[1:] if "Bucketed: true" in lines.split("SortMergeJoin")[0]]
        assert not below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_role_vectors_in_several_blocks_give_the_same_evidence(spark):
    from visret import queries
    from visret.operators import rerank
    from visret.plans import search as plans

    index, crops = queries.index(spark, SF)
    vectors = plans.role_vectors(queries.texts(spark, SF).where("query_id % 20 = 0"), queries.lookup(spark, SF), queries.LEXICON)
    found, others = plans.candidates_of(index, vectors, 7), vectors.where("role <> 'full'")
    plain = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
    one, many = (plain(rerank.evidence(found, index, crops.repartition(n), others, block_bytes=size)) for n, size in ((1, 1 << 30), (5, 1)))
    assert one == many and one


def test_both_rankings_share_candidates(spark, monkeypatch):
    from visret import queries
    from visret.plans import search

    calls, find = [], search.candidates_of
    monkeypatch.setattr(search, "candidates_of", lambda *a: calls.append(1) or find(*a))
    queries.rank_movement(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
