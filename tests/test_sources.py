"""Reading large files and folders by many tasks."""

import json
import random

import pytest

from visret.operators import regions
from visret.sources import files, json_arrays, listing, ranges


def value(rng, deep=0):
    kind = rng.randrange(8 if deep < 3 else 5)
    if kind < 2:
        return rng.choice([1, -2.5e3, True, None])
    if kind < 5:
        return "".join(rng.choice('ab{}[]",:\\ é\n') for _ in range(rng.randrange(9)))
    if kind < 7:
        return {rng.choice('xy"\\{') + str(i): value(rng, deep + 1) for i in range(rng.randrange(4))}
    return [value(rng, deep + 1) for _ in range(rng.randrange(4))]


def made(seed):
    rng = random.Random(seed)
    names = ["images", "info", "annotations", 'odd "[{\\', "categories"]
    rng.shuffle(names)
    out = {}
    for n in names:
        some = [{"id": i, "v": value(rng)} for i in range(rng.randrange(12))]
        out[n] = {"nested": some, "s": "]}"} if n == "info" else some
    out["n"] = 3
    return out


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("block", [64, 101, 1 << 20])
def test_elements_equal_a_parser(spark, tmp_path, seed, block):
    whole = made(seed)
    (tmp_path / "a b#.json").write_text(json.dumps(whole, ensure_ascii=seed % 2 == 0, indent=seed % 3 or None), encoding="utf-8")
    names = ["images", "annotations", "missing", 'odd "[{\\']
    got = {}
    for r in json_arrays.elements(spark, str(tmp_path / "a b#.json"), names, block=block).collect():
        got[r.name, r.pos] = json.loads(r.value)
    # a key is compared as it is written in the file
    assert got == {(n, i): e for n in names[:2] for i, e in enumerate(whole[n])}


def test_what_is_not_an_object_is_an_error(spark, tmp_path):
    for i, text in enumerate(('{"images": [', '{"images": [{"a": "x]}', "[]]")):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(ValueError, match="not one JSON object"):
            json_arrays.elements(spark, str(tmp_path / f"{i}.json"), ["images"])
    (tmp_path / "e.json").write_text("")
    assert json_arrays.elements(spark, str(tmp_path / "e.json"), ["images"]).count() == 0


def test_annotations_of_a_file_larger_than_a_block_are_read_by_many_tasks(spark, tmp_path):
    n = 3000
    whole = {
        "info": {"note": "[{"}, "images": [{"id": i, "file_name": f"f{i}.jpg", "width": 50 + i % 7, "height": 40, "more": {"x": [i]}} for i in range(n)],
        "categories": [{"id": 7, "name": 'sh"ir}t'}, {"id": 8}],
        "annotations": [{"image_id": i, "category_id": 7 + i % 3, "bbox": [1, 2, 20 + i % 40, 8]} for i in range(n)],
    }
    (tmp_path / "a.json").write_text(json.dumps(whole))
    blocks = ranges.blocks_of(spark, str(tmp_path / "a.json"), 4096)
    assert blocks.rdd.getNumPartitions() > 4 and blocks.selectExpr("max(length(data))").first()[0] == 4096
    i, c, a = files.annotations(spark, str(tmp_path / "a.json"), block=4096)
    got = sorted(map(tuple, regions.boxes(i, c, a).select("file_name", "ann_no", "name", "x1").collect()))
    names = {7: 'sh"ir}t', 8: "item", 9: "item"}
    assert got == sorted((f"f{k}.jpg", k, f"annotation:{names[7 + k % 3]}", min(50 + k % 7, 21 + k % 40)) for k in range(n))


def test_blocks_where_only_spark_can_read(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(bytes(range(256)) * 5)
    want = sorted(map(tuple, ranges.blocks_of(spark, str(tmp_path / "a"), 100).collect()))
    monkeypatch.setattr(ranges, "readable", lambda path: False)
    assert sorted(map(tuple, ranges.blocks_of(spark, str(tmp_path / "a"), 100).collect())) == want and len(want) == 13


def test_folders_are_walked_by_tasks(spark, tmp_path, monkeypatch):
    for p in ("x/y/z/a.jpg", "x/.hidden/b.png", "x/_c.webp", "x y/d%20.jpg", "e.JPG", "x/n.txt"):
        (tmp_path / "root" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / p).write_bytes(b"123")
    (tmp_path / "root" / "nothing").mkdir()
    (tmp_path / "root" / "x" / "loop").symlink_to(tmp_path / "root")
    root = str(tmp_path / "root")
    assert {r.path: r.length for r in listing.walked(spark, root).collect()} == {p: 3 for p in ("x/y/z/a.jpg", "x/.hidden/b.png", "x/_c.webp", "x y/d%20.jpg", "e.JPG", "x/n.txt")}
    assert {r.path for r in files.discover(spark, root + "/").collect()} == {"x/y/z/a.jpg", "x/.hidden/b.png", "x/_c.webp", "x y/d%20.jpg", "e.JPG"}
    with pytest.raises(FileNotFoundError):
        files.discover(spark, root + "/none")
    monkeypatch.setattr(files, "readable", lambda path: False)
    assert {r.path for r in files.discover(spark, root).collect()} >= {"x/y/z/a.jpg", "x y/d%20.jpg", "e.JPG"}
