"""Catalogue of image files: listing, sampling, selection lists, ids and profile."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: file names that count as images, whatever their case.
SUFFIX = r"(?i)\.(jpe?g|png|webp)$"


def image_id(path: Column) -> Column:
    """The first 16 hexadecimal digits of the relative path's SHA-1."""
    return F.substring(F.sha1(path), 1, 16)


def only_images(paths: DataFrame) -> DataFrame:
    return paths.where(F.regexp_like("path", F.lit(SUFFIX)))


def in_order(paths: DataFrame) -> DataFrame:
    return paths.orderBy(F.lower("path"), "path")


def sample(paths: DataFrame, limit: int | None, seed: int) -> DataFrame:
    """The ``limit`` paths of the smallest SHA-256 of "seed:path", in path order; all of them if
    ``limit`` is none or not positive. Repeated paths count as often as they stand."""
    if limit is None or limit <= 0:
        return in_order(paths)
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "path"), 256)
    return in_order(paths.orderBy(key, "path").limit(limit))


def resolved(value: Column) -> Column:
    """A relative path without ``.`` and inner ``..`` segments; leading ``..`` remain."""
    parts = F.filter(F.split(value, "/"), lambda s: ~s.isin("", "."))
    def step(done, s):
        back = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def judged_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """(line_no, value, path, problem) of ``lines(line_no, text)``: blank lines and those that
    begin with # are left out; problem is null, ``escapes`` or ``not a supported image``."""
    rows = (lines.select("line_no", F.trim(F.coalesce("text", F.lit(""))).alias("value"))
            .where("value <> '' and not startswith(value, '#')").withColumn("path", resolved(F.col("value"))))
    known = only_images(catalog.select("path")).distinct().withColumn("known", F.lit(True))
    outside = F.startswith("value", F.lit("/")) | (F.col("path") == "..") | F.startswith("path", F.lit("../"))
    return rows.join(known, "path", "left").select(
        "line_no", "value", "path", F.when(outside, "escapes").when(F.col("known").isNull(), "not a supported image").alias("problem"))


def selected(judged: DataFrame) -> DataFrame:
    """(line_no, path): the first line of every path, in file order."""
    return judged.where("problem is null").groupBy("path").agg(F.min("line_no").alias("line_no")).select("line_no", "path").orderBy("line_no")


def strictly_selected(judged: DataFrame) -> DataFrame:
    """``selected``, or an error that names the first line with a problem, or the lack of lines."""
    if bad := judged.where("problem is not null").orderBy("line_no").limit(1).collect():
        raise ValueError(f"line {bad[0]['line_no']}, {bad[0]['value']!r}: {bad[0]['problem']}")
    if judged.isEmpty():
        raise ValueError("the selection names no image")
    return selected(judged)


def orientation(width: Column, height: Column) -> Column:
    return F.when(height > width, "portrait").when(width > height, "landscape").otherwise("square")


def profile(images: DataFrame) -> DataFrame:
    """One row over ``images(path, width, height, corrupt)``: counts of all, valid and corrupt,
    counts by suffix (all files) and by orientation (valid files) as text, and least, median and
    largest width and height of valid files (null without any)."""
    good = ~F.col("corrupt")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    one = images.agg(
        F.count("*").alias("total"), F.count_if(good).alias("valid"), F.count_if("corrupt").alias("corrupt"),
        *[f(F.when(good, F.col(c))).cast("double").alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))])

    def counts(rows, key, name):
        pairs = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
        return pairs.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", F.col("n").cast("string")))), ",").alias(name))

    # Each of the three is a single row.
    return (one.crossJoin(F.broadcast(counts(images, suffix, "formats")))
            .crossJoin(F.broadcast(counts(images.where(good), orientation(F.col("width"), F.col("height")), "orientations"))))
