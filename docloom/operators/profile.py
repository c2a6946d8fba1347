"""Statistics of a document's fonts, spacing and layout, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.operators.paged import by_page


def font_stats(words: DataFrame) -> DataFrame:
    """doc_id, mean, std (of the population), low, high, p25, p75, p95 of font sizes; a word without one counts by its height."""
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(geo.height())
    return words.select("doc_id", size.alias("s")).groupBy("doc_id").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("low"), F.max("s").alias("high"), *[F.percentile("s", F.lit(p / 100)).alias(f"p{p}") for p in (25, 75, 95)])


def spacing_stats(boxes: DataFrame) -> DataFrame:
    """doc_id, page, mean_gap, max_gap, mean_height over neighbours from top to bottom: positive gaps only, heights of all but the last."""
    w = W.partitionBy("doc_id", "page").orderBy("y0", "region_idx")
    n = boxes.withColumn("next", F.lead("y0").over(w)).where("next is not null").withColumn("gap", F.col("next") - F.col("y1"))
    up = F.when(F.col("gap") > 0, F.col("gap"))
    return n.groupBy("doc_id", "page").agg(F.coalesce(F.avg(up), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.max(up), F.lit(0.0)).alias("max_gap"), F.avg(geo.height()).alias("mean_height"))


def thresholds(words: DataFrame, boxes: DataFrame, page_width: float = 612) -> DataFrame:
    """doc_id, heading (mean size plus 1.5 deviations), merge (the mean of the pages' least spacing), column_gap (a tenth of the page)."""
    f = font_stats(words).select("doc_id", (F.col("mean") + 1.5 * F.col("std")).alias("heading"))
    s = spacing_stats(boxes).groupBy("doc_id").agg(F.min("mean_gap").alias("merge"))
    return f.join(s, "doc_id").withColumn("column_gap", F.lit(page_width * 0.1))


def document_type(boxes: DataFrame, page_area: float = 612 * 792) -> DataFrame:
    """doc_id, page, density (area of boxes over the page), doc_type by density and counts of types."""
    c = lambda t: F.count_if(F.col("type") == t)
    s = boxes.groupBy("doc_id", "page").agg((F.sum(geo.area()) / page_area).alias("density"), c("title").alias("titles"), (c("figure") + c("table")).alias("visuals"), c("text").alias("texts"), F.count("*").alias("n"), F.avg(geo.area()).alias("size"))
    d, t = F.col("density"), F.col("texts")
    kind = (
        F.when((F.col("titles") > 0) & (F.col("visuals") > 0) & (t > 5) & (d > 0.15), "academic").when((F.col("visuals") > 0) & (t > 3) & (d > 0.12), "technical")
        .when((d < 0.08) & (F.col("n") > 10) & (F.col("size") < 50000), "form").when(d > 0.15, "technical").when(d < 0.08, "form").otherwise("technical")
    )
    return s.select("doc_id", "page", "density", kind.alias("doc_type"))


def headings_by_stats(words: DataFrame, bold: Column) -> DataFrame:
    """words that stand out: larger than the mean plus 1.5 deviations of their document by more than rounding, or bold."""
    w = W.partitionBy("doc_id")
    return words.where(words.font_size.isNotNull()).withColumn("limit", F.avg("font_size").over(w) + 1.5 * F.stddev_pop("font_size").over(w)).where((F.col("font_size") > F.col("limit") + 1e-9) | bold).drop("limit")


def importance(boxes: DataFrame) -> DataFrame:
    """boxes with importance: confidence scaled to its page's range; 0 where all are equal."""
    w = W.partitionBy("doc_id", "page")
    low, high = F.min("conf").over(w), F.max("conf").over(w)
    return boxes.withColumn("importance", (F.col("conf") - low) / F.when(high > low, high - low).otherwise(1.0))


def sure_enough(boxes: DataFrame, least: float | None = None) -> DataFrame:
    """boxes at or over a confidence: the given one, else their page's lower quartile."""
    if least is not None:
        return boxes.where(F.col("conf") >= least)
    q = boxes.groupBy("doc_id", "page").agg(F.percentile("conf", F.lit(0.25)).alias("__q"))
    return boxes.join(q, ["doc_id", "page"]).where(F.col("conf") >= F.col("__q")).select(*boxes.columns)


def text_blocks(lines: DataFrame, tall: float = 75, gap: float = 15) -> DataFrame:
    """doc_id, block_no, part, y0, y1, n: lines of blocks taller than `tall` parted where a gap of `gap` or more opens."""
    w = W.partitionBy("doc_id", "block_no").orderBy("y0", "word_idx")
    whole = W.partitionBy("doc_id", "block_no")
    height = F.max("y1").over(whole) - F.min("y0").over(whole)
    opens = (height > tall) & (F.col("y0") - F.lag("y1").over(w) >= gap)
    marked = lines.withColumn("opens", opens).withColumn("part", F.sum(F.coalesce(F.col("opens").cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "block_no", "part").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def span_words(spans: DataFrame) -> DataFrame:
    """doc_id, span_no, pos, word, x0, x1: words of a span's text, placed in proportion to their characters with a fiftieth of the width between."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    s = spans.withColumn("ws", words).where(F.size("ws") > 0).withColumn("chars", F.aggregate("ws", F.lit(0), lambda a, x: a + F.length(x)))
    e = s.select("doc_id", "span_no", "x0", "x1", "chars", F.size("ws").alias("k"), F.posexplode("ws").alias("pos", "word"))
    before = F.coalesce(F.sum(F.length("word")).over(W.partitionBy("doc_id", "span_no").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wide = F.col("x1") - F.col("x0")
    unit = wide / F.col("chars")
    a = F.col("x0") + before * unit + F.col("pos") * wide * 0.02
    return e.select("doc_id", "span_no", "pos", "word", F.when(F.col("k") == 1, F.col("x0")).otherwise(a).alias("x0"), F.when(F.col("k") == 1, F.col("x1")).otherwise(a + F.length("word") * unit).alias("x1"))


def paragraphs(boxes: DataFrame, near: float = 1.5, touch: float = -0.5, stop: float = 3.0) -> DataFrame:
    """doc_id, page, region_idx, paragraph: text boxes below each other, close and in one column, taken greedily from the top."""

    def page(ids, x0, y0, x1, y1) -> tuple:
        out, no = [-1] * len(ids), 0
        for i in range(len(ids)):
            if out[i] >= 0:
                continue
            out[i], last, tall = no, i, max(y1[i] - y0[i], 1e-9)
            for j in range(i + 1, len(ids)):
                if out[j] >= 0:
                    continue
                gap = y0[j] - y1[last]
                if gap > stop * tall:
                    break
                shared = min(x1[last], x1[j]) - max(x0[last], x0[j])
                column = shared > 0.5 * min(x1[last] - x0[last], x1[j] - x0[j]) or abs(x0[last] - x0[j]) <= 20
                if touch * tall <= gap <= near * tall and column:
                    out[j], last = no, j
            no += 1
        return ids, out

    return by_page(boxes.where("type = 'text'"), ["y0", "region_idx"], page, ["region_idx", *geo.SIDES], "region_idx int, paragraph int", ["region_idx", "paragraph"])
