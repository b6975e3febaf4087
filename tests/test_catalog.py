import pytest

from visret.operators import catalog, regions
from visret.sources import files, store


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_sample_is_repeatable_and_sorted(spark):
    names = [f"{i}.jpg" for i in range(30)]
    first = [r.path for r in catalog.sample(paths(spark, names), 10, 17).collect()]
    second = [r.path for r in catalog.sample(paths(spark, names[::-1]).repartition(5), 10, 17).collect()]
    assert first == second == sorted(first) and len(first) == 10
    assert catalog.sample(paths(spark, names), None, 17).count() == 30
    assert catalog.sample(paths(spark, names), 99, 17).count() == 30


def test_regions_are_valid(spark):
    rows = regions.heuristic(spark.createDataFrame([(852, 1024)], "width int, height int")).orderBy("region_no").collect()
    assert len(rows) == 7 and tuple(rows[0])[2:] == (0, "full", 0, 0, 852, 1024)
    assert all(r.x1 > r.x0 and r.y1 > r.y0 for r in rows)


def test_rounding_is_half_even(spark):
    a = spark.createDataFrame([(0, 1, 1, [0.5, 1.5, 2.0, 2.0]), (1, 1, 9, [2.5, 0.0, 3.0, 1.0]), (2, 1, 1, [1.0, 2.0, 3.0]), (3, 2, 1, [0.0, 0.0, 5.0, 5.0])],
                              "ann_no int, image_id int, category_id int, bbox array<double>")
    i = spark.createDataFrame([(0, 1, "x", 1, 1), (1, 1, "f.jpg", 10, 10)], "pos int, id int, file_name string, width int, height int")
    c = spark.createDataFrame([(0, 1, "hat")], "pos int, id int, name string")
    rows = regions.boxes(i, c, a).collect()
    assert [tuple(r) for r in rows] == [("f.jpg", 0, "annotation:hat", 0, 2, 2, 4, True)]


def test_table_takes_twelve_valid_boxes_in_order(spark):
    images = spark.createDataFrame([("id", "d/f.jpg", 100, 100)], "image_id string, path string, width int, height int")
    boxes = spark.createDataFrame([("f.jpg", n, f"b{n}", 0, 0, n % 3, 5, n % 3 > 0) for n in range(30)], "file_name string, ann_no int, name string, x0 int, y0 int, x1 int, y1 int, valid boolean")
    got = {r.region_no: r.name for r in regions.table(images, boxes).collect()}
    valid = [f"b{n}" for n in range(30) if n % 3]
    assert len(got) == 19 and [got[7 + i] for i in range(12)] == valid[:12]


def test_selection_is_ordered_and_deduplicated(spark, tmp_path):
    for n in ("a.jpg", "b.JPG", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "s.lst").write_text("b.JPG\n# no\n\n./a.jpg\nb.JPG\n../x.jpg\nc.txt\nsub/../a.jpg\n")
    found = files.discover(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["a.jpg", "b.JPG"]
    judged = catalog.judged_lines(files.selection_lines(spark, str(tmp_path / "s.lst")), found)
    assert [(r.line_no, r.path) for r in catalog.selected(judged).collect()] == [(1, "b.JPG"), (4, "a.jpg")]
    assert {(r.line_no, r.problem) for r in judged.where("problem is not null").collect()} == {(6, "escapes"), (7, "not a supported image")}


def test_discovery_of_odd_places(spark, tmp_path):
    """A folder of the root's own name in it, empty files, blanks and marks in names."""
    root = tmp_path / "r t"
    inner = root / str(root).strip("/")
    inner.mkdir(parents=True)
    for p in (root / "b.jpg", inner / "b.jpg", root / "a b#1%20.png", root / "n.txt"):
        p.write_bytes(b"xy")
    (root / "empty.jpg").write_bytes(b"")
    got = {r.path: r.length for r in files.discover(spark, str(root)).collect()}
    assert got == {"b.jpg": 2, f"{str(root).strip('/')}/b.jpg": 2, "a b#1%20.png": 2, "empty.jpg": 0}


def test_strict_selection(spark):
    known = paths(spark, ["a.jpg", "b.jpg"])
    lines = lambda *t: catalog.judged_lines(spark.createDataFrame([(i + 1, x) for i, x in enumerate(t)], "line_no int, text string"), known)
    assert [r.path for r in catalog.strictly_selected(lines("b.jpg", "a.jpg", "b.jpg")).collect()] == ["b.jpg", "a.jpg"]
    for t, match in ((("b.jpg", "../x.jpg"), "line 2.*escapes"), (("c.jpg",), "not a supported"), (("# no", " "), "no image")):
        with pytest.raises(ValueError, match=match):
            catalog.strictly_selected(lines(*t))


def test_profile_of_invalid_files_only(spark):
    d = spark.createDataFrame([("a.JPG", 1, 2, True)], "path string, width int, height int, corrupt boolean")
    r = catalog.profile(d).first()
    assert (r.total, r.valid, r.corrupt, r.min_width, r.formats, r.orientations) == (1, 0, 1, None, "jpg=1", "")


def test_annotations_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"images": [{"id": 1, "file_name": "f.jpg", "width": 50, "height": 40}], "categories": [],\n "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 2, 60, 8]}]}')
    i, c, a = files.annotations(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in regions.boxes(i, c, a).collect()] == [("f.jpg", 0, "annotation:item", 1, 2, 50, 10, True)]


def test_store_round_trip(spark, tmp_path):
    eye = [[float(i == j) for j in range(3)] for i in range(3)]
    images = spark.createDataFrame([(str(i), f"{i}.jpg", 5, 5, eye[i]) for i in range(3)], "image_id string, path string, width int, height int, embedding array<float>")
    crops = images.selectExpr("image_id", "0 AS region_no", "'full' AS name", "embedding")
    store.write(images, crops, str(tmp_path / "index"), "fake")
    a, b, m = store.load(spark, str(tmp_path / "index"), "fake")
    assert (m["dimension"], m["image_count"], m["max_regions"]) == (3, 3, 1) and b.count() == 3
    files = [f for f in (tmp_path / "index").rglob("*") if f.is_file() and f.name[0] not in "._"]
    assert store.size(spark, str(tmp_path / "index")) == sum(f.stat().st_size for f in files) > 0
    with pytest.raises(ValueError, match="other|made by"):
        store.load(spark, str(tmp_path / "index"), "another")
    with pytest.raises(ValueError, match="no images"):
        store.write(images.limit(0), crops.limit(0), str(tmp_path / "empty"), "fake")


def test_index_is_built_from_records(spark, tmp_path):
    from visret.plans import indexing

    images = spark.createDataFrame([("d/f.jpg", 100, 80), ("g.jpg", 50, 50)], "path string, width int, height int")
    boxes = spark.createDataFrame([("f.jpg", 3, "annotation:hat", 1, 2, 9, 9, True)], "file_name string, ann_no int, name string, x0 int, y0 int, x1 int, y1 int, valid boolean")
    asked = []

    def encode(crops):
        asked.extend((r.path, r.region_no) for r in crops.collect())
        return crops.selectExpr("path", "region_no", "array(cast(x1 - x0 as double), cast(y1 - y0 as double)) as embedding")

    indexing.build(images, boxes, encode, str(tmp_path / "i"), "m")
    a, b, m = store.load(spark, str(tmp_path / "i"), "m")
    assert m["image_count"] == 2 and m["max_regions"] == 8 and b.count() == 15 and len(asked) == 15
    row = a.where("path = 'd/f.jpg'").first()
    assert [round(x, 6) for x in row.embedding] == [round(100 / 16400**0.5, 6), round(80 / 16400**0.5, 6)]
    asked.clear()
    cached = spark.createDataFrame([("g.jpg#0", "m", [3.0, 4.0]), ("g.jpg#1", "other", [1.0, 0.0])], "path string, model_id string, embedding array<double>")
    indexing.build(images, boxes, encode, str(tmp_path / "j"), "m", cached)
    assert len(asked) == 14 and ("g.jpg", 0) not in asked
    assert store.load(spark, str(tmp_path / "j"))[0].where("path = 'g.jpg'").first().embedding == [0.6, 0.8]
    b.where("region_no <> 7").write.parquet(str(tmp_path / "k" / "regions"))
    for part in ("images", "manifest"):
        (tmp_path / "k" / part).symlink_to(tmp_path / "i" / part)
    with pytest.raises(ValueError, match="disagree"):
        store.load(spark, str(tmp_path / "k"))


def test_curation_is_written(spark, tmp_path):
    import json

    from visret.plans import curation

    images = spark.createDataFrame([(str(i), f"p{i}.jpg", [float(i), 10.0 - i]) for i in range(6)], "image_id string, path string, embedding array<double>")
    facets = spark.createDataFrame([(0, "axis", "x", ["x"], 2), (1, "axis", "y", ["y", "y y"], 1)], "facet_no long, axis string, name string, prompts array<string>, quota int")
    encoder = lambda prompts: prompts.selectExpr("prompt", "if(prompt = 'x', array(1D, 0D), array(0D, 1D)) as vec")
    curation.run(images, encoder, str(tmp_path), facets)
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert read("selection").split() == ["p5.jpg", "p0.jpg", "p4.jpg"]
    assert [json.loads(line) for line in read("counts").splitlines()] == [{"axis": "axis", "label": "x", "n": 2}, {"axis": "axis", "label": "y", "n": 1}]
    report = [json.loads(line) for line in read("coverage").splitlines()]
    assert [r["name"] for r in report] == ["x", "y"] and report[0]["best"][0]["path"] == "p5.jpg" and report[0]["maximum"] == round(5 / 50**0.5, 6)


def test_results_are_written_apart_and_together(spark, tmp_path):
    from visret.plans.search import nested

    rows = nested(spark.createDataFrame([(q, r, f"i{r}", 0.5) for q in ("q1", "q2") for r in (2, 1)], "query_id string, rank int, image_id string, score double"))
    store.write_results(rows, str(tmp_path / "each"))
    assert sorted(p.name for p in (tmp_path / "each").iterdir() if p.is_dir()) == ["query_id=q1", "query_id=q2"]
    store.write_results(rows, str(tmp_path / "all"), combined=True)
    got = spark.read.json(str(tmp_path / "all")).collect()
    assert len(list((tmp_path / "all").glob("part-*"))) == 1 and [r.query_id for r in got] == ["q1", "q2"] and [h.image_id for h in got[0].results] == ["i1", "i2"]
