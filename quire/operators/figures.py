"""Figures: which question an image belongs to, captions, file names, links with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_SIDE, MIN_AREA, BACKGROUND = 35, 1200, 0.80


def usable(images: DataFrame, page_width: str = "page_width", page_height: str = "page_height") -> DataFrame:
    """Neither tiny nor a page's background. images: x0, y0, x1, y1."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.filter((w >= MIN_SIDE) & (h >= MIN_SIDE) & (w * h >= MIN_AREA) & ~((w >= BACKGROUND * F.col(page_width)) & (h >= BACKGROUND * F.col(page_height))))


def nearest(images: DataFrame, questions: DataFrame, on: list[str], image: str, centre: Column, low: Column, high: Column, order: str) -> DataFrame:
    """Of each image the question that holds its centre (the first), else the one whose middle is nearest (ties to the first).
    An aggregate over the equi-join, so nothing is sorted."""
    both = images.join(questions, on)
    inside = centre.between(low, high)
    far = F.when(inside, F.lit(0.0)).otherwise(F.abs(centre - (low + high) / 2))
    rank = F.struct(F.when(inside, 0).otherwise(1).alias("outside"), far.cast("double").alias("distance"), F.col(order).alias("order"))
    return both.groupBy(*on, image).agg(F.min(rank).alias("r")).select(*on, image, F.col("r.order").alias(order), (F.col("r.outside") == 0).alias("inside"), F.col("r.distance").alias("distance"))


def continued(images: DataFrame, questions: DataFrame, on: list[str], image: str, page: str = "page_num", seq: str = "seq") -> DataFrame:
    """Images at the top of a page (y0 < 150) that go on from the last question of the page before, if it starts low (y0 > 500)."""
    last = questions.groupBy(*on, page).agg(F.max_by(F.struct(seq, "y0"), seq).alias("q"))
    before = last.filter("q.y0 > 500").select(*on, (F.col(page) + 1).alias(page), F.col("q")[seq].alias(seq))
    return images.filter((F.col("y0") < 150) & (F.col(page) > 1)).join(before, [*on, page]).select(*on, page, image, seq)


def numbered(images: DataFrame, question: list[str], order: str) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*question).orderBy(order))
    return images.withColumn("image_number", at).withColumn("filename", F.concat(F.concat_ws("_", *question), F.format_string("_img%d.png", at)))


def captions(images: DataFrame, words: DataFrame, on: list[str], image: str, margin: float = 80, longest: int = 200) -> DataFrame:
    """The words whose boxes overlap an image's, enlarged by the margin, in order."""
    near = images.alias("i").join(words.alias("w"), on).filter((F.col("w.x0") <= F.col("i.x1") + margin) & (F.col("w.x1") >= F.col("i.x0") - margin) & (F.col("w.y0") <= F.col("i.y1") + margin) & (F.col("w.y1") >= F.col("i.y0") - margin))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.seq", "w.text"))), lambda x: x["text"]), " ")
    return near.groupBy(*on, image).agg(F.substring(joined, 1, longest).alias("caption_nearby"))


def resolved(references: DataFrame, ref: str, *steps: tuple[DataFrame, str]) -> DataFrame:
    """Adds `url`: from the first table (with columns `ref` and the one named) that has it."""
    names = []
    for i, (found, column) in enumerate(steps):
        references = references.join(found.select(F.col(ref), F.col(column).alias(f"_step{i}")).dropDuplicates([ref]), ref, "left")
        names.append(f"_step{i}")
    return references.withColumn("url", F.coalesce(*names)).drop(*names)


def union_box(boxes: DataFrame, *by: str) -> DataFrame:
    """The box around the boxes (x0, y0, x1, y1) of each group."""
    return boxes.groupBy(*by).agg(*(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")))


def letters(position: Column) -> Column:
    """0 is a, 25 is z; from 26 on the number itself."""
    return F.when(position < 26, F.char(position + 97)).otherwise((position + 1).cast("string"))
