"""Crop boxes of images: seven by rule, and up to twelve from annotations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name and left, top, right and bottom edge of each crop as shares of the image.
CROPS = (
    ("full", None, None, None, None),
    ("upper", None, None, None, 0.58),
    ("torso", 0.12, 0.12, 0.88, 0.68),
    ("lower", None, 0.42, None, None),
    ("center", 0.16, 0.16, 0.84, 0.84),
    ("left", None, 0.08, 0.58, 0.92),
    ("right", 0.42, 0.08, None, 0.92),
)
ANNOTATED = 12  # boxes of an image that are used at most
BROADCAST_ROWS = 100_000  # categories (some 100 bytes each) that are broadcast at most


def edge(size: Column, share: float | None, otherwise: Column) -> Column:
    """Rounded half to even, as an int."""
    return otherwise.cast("int") if share is None else F.rint(size * F.lit(share)).cast("int")


def heuristic(images: DataFrame) -> DataFrame:
    """``images`` with (region_no, name, x0, y0, x1, y1), seven rows each."""
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    boxes = []
    for name, x0, y0, x1, y1 in CROPS:
        bottom = edge(h, y1, h)
        boxes.append(F.struct(
            F.lit(name).alias("name"), edge(w, x0, zero).alias("x0"), edge(h, y0, zero).alias("y0"), edge(w, x1, w).alias("x1"),
            (F.greatest(bottom, F.lit(1)) if name == "upper" else bottom).alias("y1")))
    return images.select("*", F.posexplode(F.array(*boxes)).alias("region_no", "box")).select(*images.columns, "region_no", "box.*")


def boxes(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """(file_name, ann_no, name, x0, y0, x1, y1, valid) of annotations (ann_no, image_id,
    category_id, bbox), joined to images (pos, id, file_name, width, height) and categories (pos,
    id, name). Of repeated ids the last position holds; an annotation without an image, with a box
    that isn't four numbers, of width or height 1 or less, or on an image without size is left
    out. Boxes are clamped; those that clamping turns empty are kept as not valid.
    """
    last = lambda d: d.groupBy("id").agg(F.max_by(F.struct(*[c for c in d.columns if c != "id"]), "pos").alias("r")).select("id", "r.*")
    i = last(images).drop("pos").withColumnRenamed("id", "image_id")
    c = last(categories).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    few = c.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    b = [F.try_element_at("bbox", F.lit(k)) for k in (1, 2, 3, 4)]
    x, y, w, h = b
    round_ = lambda v: F.rint(v).cast("int")
    return (annotations.where(F.size("bbox") == 4).where((w > 1) & (h > 1))
            .join(i, "image_id").where("width > 0 and height > 0").join(F.broadcast(c) if few else c, "category_id", "left")
            .select("file_name", "ann_no", F.concat(F.lit("annotation:"), F.coalesce("category", F.lit("item"))).alias("name"),
                    F.greatest(F.lit(0), round_(x)).alias("x0"), F.greatest(F.lit(0), round_(y)).alias("y0"),
                    F.least("width", round_(x + w)).alias("x1"), F.least("height", round_(y + h)).alias("y1"))
            .withColumn("valid", (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))))


def table(images: DataFrame, annotated: DataFrame, most: int = ANNOTATED) -> DataFrame:
    """(image_id, region_no, name, x0, y0, x1, y1) of ``images(image_id, path, width, height)``:
    the seven crops and then the first ``most`` valid annotated boxes of the file's name, in their
    order (ties by name and box)."""
    box = ["name", "x0", "y0", "x1", "y1"]
    w = Window.partitionBy("file_name").orderBy("ann_no", *box)  # images of one file name have the same boxes
    first = annotated.where("valid").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    own = (images.select("image_id", F.element_at(F.split("path", "/"), -1).alias("file_name"))
           .join(first, "file_name").select("image_id", (F.col("n") + len(CROPS) - 1).alias("region_no"), *box))
    return heuristic(images.select("image_id", "width", "height")).select("image_id", "region_no", *box).unionByName(own)
