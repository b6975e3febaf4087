"""Appending to tables that have rows already."""

import pytest
from pyspark.sql import functions as F

from visret.streaming import append
from visret.streaming.append import append_new, append_stream, keyed

ROW = "id int, html string, n long"


def stream(spark, tmp_path):
    source = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
    append_stream(source, "html", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return sorted(((r.html, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def arrive(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_a_filled_target_keeps_its_rows_and_gets_new_ones_only(spark, tmp_path):
    append_new(spark, spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "b", None)], ROW), "html", str(tmp_path / "out"))
    arrive(spark, tmp_path, (4, "a", 4), (5, "z", (1 << 60) + 1))
    assert stream(spark, tmp_path) == [("a", 1), ("b", None), ("z", (1 << 60) + 1)]
    arrive(spark, tmp_path, (6, "z", 6), (7, None, 7), (8, "", 7), (9, "b", 9))
    got = stream(spark, tmp_path)
    assert len(got) == 4 and {h or "" for h, _ in got} == {"a", "b", "z", ""}
    assert stream(spark, tmp_path) == got  # nothing has come
    append_new(spark, spark.createDataFrame([(1, "a", 1), (2, "q", 2)], ROW), "html", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_a_batch_that_is_repeated_after_it_was_written_changes_nothing(spark, tmp_path, monkeypatch):
    arrive(spark, tmp_path, (1, "a", 1), (2, "b", 2))
    with monkeypatch.context() as m:
        def stop(*_):
            raise RuntimeError("lost")
        m.setattr(append, "remove", stop)  # after the rows are written, before the batch is known to be done
        with pytest.raises(Exception, match="lost"):
            stream(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert stream(spark, tmp_path) == [("a", 1), ("b", 2)]
    arrive(spark, tmp_path, (3, "b", 3), (4, "c", 4))
    assert stream(spark, tmp_path) == [("a", 1), ("b", 2), ("c", 4)]


def test_a_target_without_keys_and_one_of_a_file_sink(spark, tmp_path):
    spark.createDataFrame([(1, "a", 1)], ROW).write.parquet(str(tmp_path / "out"))
    arrive(spark, tmp_path, (2, "a", 2), (3, "c", 3))
    assert stream(spark, tmp_path) == [("a", 1), ("c", 3)]
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["id", "html", "n"]
    (tmp_path / "out" / "_spark_metadata").mkdir()
    with pytest.raises(ValueError, match="file sink"):
        append_new(spark, spark.createDataFrame([(1, "a", 1)], ROW), "html", str(tmp_path / "out"))


def test_keys_take_null_as_empty(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 2)], ROW)
    assert keyed(rows, "html").agg(F.count_distinct("content_key")).first()[0] == 1
