"""What a page delivers before any region is known: words, drawings, images, sizes; and boxes from contours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip


def words(pages: DataFrame) -> DataFrame:
    """doc_id, id, text, x0, y0, x1, y1, block_no, line_no, word_no of pages(doc_id, words): tuples without fonts; blank ones go, ids stay."""
    each = pages.select("doc_id", F.posexplode("words").alias("id", "w")).withColumn("text", strip(F.col("w.text"))).where("text <> ''")
    number = lambda c: F.coalesce(f"w.{c}", F.lit(0)).alias(c)
    return each.select("doc_id", "id", "text", "w.x0", "w.y0", "w.x1", "w.y1", number("block_no"), number("line_no"), number("word_no"))


def drawings(pages: DataFrame) -> DataFrame:
    """doc_id, draw_no, kind (line or rect), the path's box, its width (1 if not given) of pages(doc_id, draw_no, rect, items, width).

    Items are commands with points: l is a line, re a rectangle, others go, and so do paths without a box.
    """
    each = pages.where(F.col("rect").isNotNull()).select("doc_id", "draw_no", "rect", F.coalesce("width", F.lit(1.0)).alias("width"), F.explode("items").alias("i"))
    kind = F.when((F.col("i.cmd") == "l") & (F.size("i.points") >= 2), "line").when(F.col("i.cmd") == "re", "rect")
    return each.select("doc_id", "draw_no", kind.alias("kind"), "rect.*", "width").where(F.col("kind").isNotNull())


def images(pages: DataFrame) -> DataFrame:
    """doc_id, x0, y0, x1, y1, width, height: each place of each image of pages(doc_id, images)."""
    each = pages.select("doc_id", F.explode("images").alias("m")).select("doc_id", "m.width", "m.height", F.explode("m.rects").alias("r"))
    return each.select("doc_id", "r.*", "width", "height")


def page_info(pages: DataFrame) -> DataFrame:
    """doc_id, page, rotation, width, height and the crop and media boxes of pages(…, rect, cropbox, mediabox); a missing box is null."""
    side = lambda a, b: F.col(f"rect.{b}") - F.col(f"rect.{a}")
    return pages.select("doc_id", "page", "rotation", side("x0", "x1").alias("width"), side("y0", "y1").alias("height"), "cropbox", "mediabox")


def contour_regions(boxes: DataFrame) -> DataFrame:
    """boxes(…, ruled, x, y, w, h, page_width, page_height) that are large enough, with type and confidence.

    Contours of ruled lines are tables; others are titles if tall and not very wide, else text.
    """
    area, page = F.col("w") * F.col("h"), F.col("page_width") * F.col("page_height")
    table = F.col("ruled") & (area > page * 0.01) & (F.col("w") > 100) & (F.col("h") > 50)
    text = ~F.col("ruled") & (area > 100) & (F.col("w") > 20) & (F.col("h") > 10)
    kind = F.when(table, "Table").when(text & (F.col("h") > 20) & (F.col("w") / F.col("h") < 10), "Title").when(text, "Text")
    return boxes.withColumn("type", kind).where(F.col("type").isNotNull()).withColumn("confidence", F.when(F.col("type") == "Table", 0.7).otherwise(0.6))
