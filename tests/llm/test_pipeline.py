"""The pipeline's stages one by one, and the entry with and without this subpackage."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import corpus_pipeline
from visret.llm import common, quality, queries
from visret.llm.common import read

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    d = read(spark, SF, "documents")
    first, columns, counts = set(d.columns), d.columns, [d.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and set(out.columns) == first
            assert out.join(d, "doc_id", "left_anti").count() == 0
            counts.append(out.count())
            d = out
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in d.select("doc_id").collect()}
    assert all(a > b for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] > 0.6 * counts[0]
    good = read(spark, SF, "labels").where("quality = 1").count()
    kept = spark.read.parquet(str(tmp_path / "quality")).join(read(spark, SF, "labels").where("quality = 1"), "doc_id").count()
    assert kept > 0.97 * good


def test_run_equals_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    d = read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, sf).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows.columns == d.columns and rows.columns[:5] == columns
    whole = lambda t: sorted((r.doc_id, r.doc_tokens) for r in t.select("doc_id", "doc_tokens").distinct().collect())
    assert whole(rows) == whole(d) and len(whole(rows)) > 0.6 * read(spark, sf, "documents").count()
    assert rows.agg({"length": "sum"}).first() == d.agg({"length": "sum"}).first()


def test_only_the_last_stage_stays_on_disk(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
    folder = Path(rows.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent.parent
    assert [p.name for p in folder.iterdir() if p.is_dir()] == ["packing"]


def test_stages_of_an_empty_table(spark, tmp_path):
    d = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))


def test_entry_stands_without_this_subpackage_or_what_it_needs():
    for missing in ("'visret.llm', 'corpus_pipeline'", "'xxhash'", "'tokenizers', 'zstandard'"):
        code = (f"import sys\nclass No:\n    def find_spec(self, name, *_):\n        if name.startswith(({missing},)):\n"
                "            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\n"
                "assert 'search_structured' in e.queries() and 'pipeline' not in e.queries() and 'pipeline' not in e.oracle_sql()\n")
        subprocess.run([sys.executable, "-c", code], check=True, cwd=str(Path(corpus_pipeline.__file__).parent))


def test_sample_comes_to_the_driver_without_an_object_for_each_number(spark):
    """A number takes some bytes, not the 40 of an object in a list; features and order are whole."""
    found = spark.range(50).selectExpr("id % 2 as y", "id as draw", "transform(sequence(1, 20000), x -> int(x * 13 + id)) as features")
    tracemalloc.start()
    try:
        rows, y = quality.sampled(found, 1000, 1 << 30)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * 50 * 20000
    assert y.tolist() == [0] * 25 + [1] * 25
    for i, r in zip([*range(0, 50, 2), *range(1, 50, 2)], rows, strict=True):
        assert len(r) == 20000 and r[0] == 13 + i and r[-1] == 13 * 20000 + i


def test_a_round_of_components_has_few_tasks(spark):
    """The driver keeps record of every task: with 16 partitions and nothing coalesced a settled star takes
    two rounds."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "")
        got = common.components(spark.range(1, 41).selectExpr("id as a", "0L as b"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert {r.component for r in got.collect()} == {0} and got.count() == 41
    assert 0 < tasks < 300, tasks  # 406 with tables of both orders of every edge
