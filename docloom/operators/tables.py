"""Joins of words, drawings and captions with boxes, and the reconstruction of tables.

Words are rows of doc_id, word_idx, text, x0, y0, x1, y1, font_size, fontname; drawings of doc_id,
line_idx, kind and a box. A table's box comes as columns t_x0..t_y1 on its document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.functions.text import is_caption, strip
from docloom.operators.paged import by_page, carried
from docloom.operators.regions import pairs

# Words that mark technical tables.
ANCHORS = ("parameter", "conditions", "value", "bedingungen", "wert", "u_in", "i_out", "v dc", "v ac", "typ.", "max.", "min.", "function")
PLACEHOLDER = r"(?i)^(?:Cell_\d+_\d+|Col\d+|Row\d+|Column\d+|R\d+C\d+)$"


def in_table(things: DataFrame, tables: DataFrame, share: float) -> DataFrame:
    """things of which `share` or more lies in their document's table; tables: doc_id, t_x0..t_y1."""
    p = things.join(tables, "doc_id")
    both = F.greatest(F.least("x1", "t_x1") - F.greatest("x0", "t_x0"), F.lit(0.0)) * F.greatest(F.least("y1", "t_y1") - F.greatest("y0", "t_y0"), F.lit(0.0))
    return p.where(F.when(geo.area() > 0, both / geo.area()).otherwise(0.0) >= share)


def caption_parents(boxes: DataFrame, near: float = 60, centres: float = 150) -> DataFrame:
    """doc_id, page, caption_idx, parent_idx, distance: for captions, and texts that read like one, the figure or table closest above or below and aligned."""
    caps = boxes.where((F.col("type") == "caption") | ((F.col("type") == "text") & is_caption(F.col("text"))))
    p = pairs(caps, boxes.where(F.col("type").isin("figure", "table")))
    up = F.least(F.abs(F.col("a_y0") - F.col("b_y1")), F.abs(F.col("b_y0") - F.col("a_y1")))
    over = F.greatest(F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.lit(0.0))
    apart = F.abs((F.col("a_x0") + F.col("a_x1")) / 2 - (F.col("b_x0") + F.col("b_x1")) / 2)
    fit = p.withColumn("distance", up).where((F.col("distance") < near) & ((over > 0) | (apart < centres)))
    rank = F.row_number().over(W.partitionBy("a_doc_id", "a_page", "a_region_idx").orderBy("distance", F.when(F.col("b_type") == "figure", 0).otherwise(1), "b_region_idx"))
    best = fit.withColumn("rank", rank).where("rank = 1")
    return best.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("caption_idx"), F.col("b_region_idx").alias("parent_idx"), "distance")


def anchor_candidates(boxes: DataFrame, search: float = 120, tolerance: float = 50) -> DataFrame:
    """doc_id, page, table_idx, text_idx, distance: the text, title or heading nearest above or beside each table.

    Strict alignment first; where nothing fits, texts beside the table up to 200 past its right edge.
    """
    p = pairs(boxes.where(F.col("type") == "table"), boxes.where(F.col("type").isin("text", "title", "heading")))
    up = F.col("a_y0") - F.col("b_y1")
    beside = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0") > 0
    off = F.abs(F.col("b_x0") - F.col("a_x0"))
    right = F.greatest(F.col("a_x0") - F.col("b_x1"), F.lit(0.0))
    lower = F.abs(F.col("a_y0") - F.col("b_y0"))
    strict = (up.between(-20, search) | beside) & ((off <= tolerance) | (F.col("b_x1") <= F.col("a_x0") + 30))
    loose = beside & (F.col("b_x1") <= F.col("a_x1") + 200)
    d = F.when(strict, F.when(beside, right + lower * 0.5).otherwise(F.sqrt(up * up + off * off))).when(loose, right + lower * 0.1)
    scored = p.withColumns({"distance": d, "pass": F.when(strict, 0).otherwise(1)}).where("distance is not null")
    rank = F.row_number().over(W.partitionBy("a_doc_id", "a_page", "a_region_idx").orderBy("pass", "distance", "b_region_idx"))
    best = scored.withColumn("rank", rank).where("rank = 1")
    return best.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("table_idx"), F.col("b_region_idx").alias("text_idx"), "distance")


def anchors(boxes: DataFrame, search: float = 120, tolerance: float = 50) -> DataFrame:
    """doc_id, page, table_idx, text_idx: tables in order take their nearest text that no earlier table took."""

    def page(ids, kinds, x0, y0, x1, y1) -> tuple:
        tables, texts = np.flatnonzero(kinds == "table"), np.flatnonzero(kinds != "table")
        free, out = np.ones(len(texts), bool), []
        for t in tables:
            up, off = y0[t] - y1[texts], np.abs(x0[texts] - x0[t])
            beside = np.minimum(y1[t], y1[texts]) - np.maximum(y0[t], y0[texts]) > 0
            right, lower = np.maximum(x0[t] - x1[texts], 0), np.abs(y0[t] - y0[texts])
            strict = free & (((up >= -20) & (up <= search)) | beside) & ((off <= tolerance) | (x1[texts] <= x0[t] + 30))
            loose = free & beside & (x1[texts] <= x1[t] + 200)
            fit, near = (strict, np.where(beside, right + lower * 0.5, np.hypot(up, off))) if strict.any() else (loose, right + lower * 0.1)
            if fit.any():
                best = int(np.where(fit, near, np.inf).argmin())
                free[best] = False
                out.append((ids[t], ids[texts[best]]))
        return [a for a, _ in out], [b for _, b in out]

    regions = boxes.where(F.col("type").isin("table", "text", "title", "heading"))
    return by_page(regions, ["region_idx"], page, ["region_idx", "type", *geo.SIDES], "table_idx int, text_idx int", ["table_idx", "text_idx"])


def best_matches(texts: DataFrame, boxes: DataFrame, least: float = 0.2) -> DataFrame:
    """doc_id, page, text_idx, region_idx, iou: the compatible region with the largest IoU over `least`."""
    fit = ((F.col("b_type") == "figure") & F.col("a_type").isin("caption", "text")) | ((F.col("b_type") == "table") & F.col("a_type").isin("heading", "text"))
    p = pairs(texts, boxes, when=fit & (geo.intersection("a_", "b_") > 0)).withColumn("iou", geo.iou("a_", "b_")).where(F.col("iou") > least)
    best = p.groupBy("a_doc_id", "a_page", "a_region_idx").agg(F.max_by(F.struct("b_region_idx", "iou"), F.struct("iou", -F.col("b_region_idx"))).alias("m"))
    return best.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("text_idx"), F.col("m.b_region_idx").alias("region_idx"), F.col("m.iou").alias("iou"))


def dominant_fonts(regions: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, region_idx, fontname, font_size, n: the most frequent font of the words whose centre lies in each region; of equals the one seen first."""
    a, b = geo.renamed(words, "w_"), geo.renamed(regions, "r_")
    p = a.join(b, (F.col("w_doc_id") == F.col("r_doc_id")) & geo.centre_in("w_", "r_"))
    size = F.round("w_font_size", 1)
    counted = p.groupBy("r_doc_id", "r_region_idx", "w_fontname", size.alias("size")).agg(F.count("*").alias("n"), F.min("w_word_idx").alias("first"))
    best = counted.groupBy("r_doc_id", "r_region_idx").agg(F.max_by(F.struct("w_fontname", "size", "n"), F.struct("n", -F.col("first"))).alias("m"))
    return best.select(F.col("r_doc_id").alias("doc_id"), F.col("r_region_idx").alias("region_idx"), F.col("m.w_fontname").alias("fontname"), F.col("m.size").alias("font_size"), F.col("m.n").alias("n"))


def bold(name: Column) -> Column:
    return F.lower(name).rlike("bold|black|heavy")


def italic(name: Column) -> Column:
    return F.lower(name).rlike("italic|oblique")


def stylesheet(words: DataFrame) -> DataFrame:
    """doc_id, body, h1, h2, h3 as size/font texts: body is the most frequent upright-weight font; headings are larger, or as large and bold."""
    name = F.concat_ws("/", F.col("font_size").cast("decimal(6,1)").cast("string"), "fontname")
    fonts = words.groupBy("doc_id", "font_size", "fontname").agg(F.count("*").alias("n"), F.min("word_idx").alias("first")).withColumns({"bold": F.lower("fontname").rlike("bold|black"), "name": name})
    body = fonts.groupBy("doc_id").agg(F.max_by(F.struct("font_size", "bold", "name"), F.struct(~F.col("bold"), "n", -F.col("first"))).alias("b"))
    heads = fonts.join(body, "doc_id").where((F.col("font_size") > F.col("b.font_size") + 0.5) | ((F.abs(F.col("font_size") - F.col("b.font_size")) <= 0.5) & F.col("bold") & ~F.col("b.bold")))
    ranked = heads.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("font_size"), F.desc("bold"), "first"))).where("k <= 3")
    pick = ranked.groupBy("doc_id").agg(*[F.max(F.when(F.col("k") == i, F.col("name"))).alias(f"h{i}") for i in (1, 2, 3)])
    return body.join(pick, "doc_id", "left").select("doc_id", F.col("b.name").alias("body"), "h1", "h2", "h3")


def row_groups(words: DataFrame, tolerance: float) -> DataFrame:
    """words with row_no: by top edge; a row takes words within tolerance of its first one's top."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"))

    def step(s: Column, w: Column) -> tuple[Column, Column]:
        new = s["anchor"].isNull() | (F.abs(w["y0"] - s["anchor"]) > tolerance)
        no = s["row"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, w["y0"]).otherwise(s["anchor"]).alias("anchor"), no.alias("row")), F.struct(no.alias("row_no"))

    return carried(words, ["doc_id"], ["y0", "word_idx"], start, step, "struct<anchor:double,row:int>", "struct<row_no:int>")


def row_tolerance(words: DataFrame, factor: float, least: float) -> DataFrame:
    """doc_id, tolerance: `factor` of the upper median font size, `least` at least."""
    sizes = F.sort_array(F.collect_list(F.when(F.col("font_size") > 0, F.col("font_size"))))
    return words.groupBy("doc_id").agg(sizes.alias("s")).select("doc_id", F.greatest(F.lit(least), F.get("s", F.floor(F.size("s") / 2).cast("int")) * factor).alias("tolerance"))


def merged_boundaries(positions: DataFrame, tolerance: float) -> DataFrame:
    """doc_id, boundaries of (doc_id, pos): a position within tolerance of the last boundary moves it to their mean."""
    kind = "array<double>"

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        moved = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array((last + p) / 2))
        return F.when(F.size(acc) == 0, F.array(p)).when(p - last > tolerance, F.concat(acc, F.array(p))).otherwise(moved)

    listed = positions.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    return listed.select("doc_id", F.aggregate("ps", F.array().cast(kind), step).alias("boundaries"))


def collinear(lines: DataFrame, axis: str, step: float = 3) -> DataFrame:
    """doc_id, place, low, high, n: horizontal (axis y) or vertical (axis x) lines on one place, their mean place and whole reach."""
    along = "x" if axis == "y" else "y"
    key = F.rint((F.col(f"{axis}0") + F.col(f"{axis}1")) / 2 / step) * step
    return lines.groupBy("doc_id", key.alias("key")).agg(
        F.avg((F.col(f"{axis}0") + F.col(f"{axis}1")) / 2).alias("place"), F.min(F.least(f"{along}0", f"{along}1")).alias("low"), F.max(F.greatest(f"{along}0", f"{along}1")).alias("high"), F.count("*").alias("n")
    )


def column_split(words: DataFrame, tables: DataFrame, least: float = 0.05) -> DataFrame:
    """doc_id, split, gap: the widest gap between neighbouring word centres whose middle lies in the table's middle three fifths."""
    w = words.join(tables, "doc_id").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    gaps = w.withColumn("next", F.lead("cx").over(W.partitionBy("doc_id").orderBy("cx", "word_idx"))).where("next is not null")
    place = ((F.col("cx") + F.col("next")) / 2 - F.col("t_x0")) / (F.col("t_x1") - F.col("t_x0"))
    fit = gaps.where((place > 0.2) & (place < 0.8) & (F.col("next") > F.col("cx")))
    best = fit.groupBy("doc_id", "t_x0", "t_x1").agg(F.max_by(F.struct("cx", "next"), F.struct(F.col("next") - F.col("cx"), -F.col("cx"))).alias("m"))
    gap = F.col("m.next") - F.col("m.cx")
    return best.where(gap >= (F.col("t_x1") - F.col("t_x0")) * least).select("doc_id", ((F.col("m.cx") + F.col("m.next")) / 2).alias("split"), gap.alias("gap"))


def kv_scores(words: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, kv_score of a table's words: 0.7 of the widest gap's share of the width, and 0.3 of the balance of both sides."""
    w = words.join(tables, "doc_id").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    n = F.count("*").over(W.partitionBy("doc_id"))
    gaps = w.withColumns({"next": F.lead("cx").over(W.partitionBy("doc_id").orderBy("cx", "word_idx")), "n": n})
    widest = gaps.where("next is not null").groupBy("doc_id").agg(F.max_by(F.struct("cx", "next"), F.struct(F.col("next") - F.col("cx"), -F.col("cx"))).alias("m")).select("doc_id", ((F.col("m.cx") + F.col("m.next")) / 2).alias("at"), (F.col("m.next") - F.col("m.cx")).alias("gap"))
    sides = gaps.join(widest, "doc_id", "left").groupBy("doc_id", "t_x0", "t_x1", "n", "at", "gap").agg(F.count_if(F.col("cx") < F.col("at")).alias("l"), F.count_if(F.col("cx") > F.col("at")).alias("r"))
    wide = F.col("t_x1") - F.col("t_x0")
    place = (F.col("at") - F.col("t_x0")) / wide
    score = F.col("gap") / wide * 0.7 + F.when(F.greatest("l", "r") > 0, F.least("l", "r") / F.greatest("l", "r")).otherwise(0.0) * 0.3
    return sides.select("doc_id", F.when((F.col("n") < 4) | ~((place > 0.2) & (place < 0.8)), 0.0).otherwise(F.least(F.lit(1.0), score)).alias("kv_score"))


def ruled_scores(lines: DataFrame, tables: DataFrame, shortest: float = 10) -> DataFrame:
    """doc_id, ruled_score: length of horizontal and vertical lines over the table's perimeter, 0 without two of each."""
    inside = lines.join(tables, "doc_id").where((F.col("kind") == "line") & (geo.length() >= shortest))
    long, h, v = geo.length(), geo.horizontal(), geo.vertical() & ~geo.horizontal()
    s = inside.groupBy("doc_id", "t_x0", "t_y0", "t_x1", "t_y1").agg(F.sum(F.when(h | v, long).otherwise(0.0)).alias("length"), F.count_if(h).alias("hs"), F.count_if(v).alias("vs"))
    perimeter = 2 * (F.col("t_x1") - F.col("t_x0") + F.col("t_y1") - F.col("t_y0"))
    return s.select("doc_id", F.when((perimeter <= 0) | (F.col("hs") < 2) | (F.col("vs") < 2), 0.0).otherwise(F.least(F.lit(1.0), F.col("length") / perimeter)).alias("ruled_score"))


def wide_gaps(words: DataFrame, tables: DataFrame, bins: int = 100, least: int = 8) -> DataFrame:
    """doc_id, n_gaps: runs of `least` or more empty of the bins 10 to 89 across the table; 0 with fewer than six words."""
    wide = F.col("t_x1") - F.col("t_x0")
    w = words.join(tables, "doc_id")
    low = F.greatest(F.lit(0), ((F.col("x0") - F.col("t_x0")) / wide * bins).cast("int"))
    high = F.least(F.lit(bins - 1), ((F.col("x1") - F.col("t_x0")) / wide * bins).cast("int"))
    full = w.where(high >= low).select("doc_id", F.explode(F.sequence(low, high)).alias("bin"))
    per = w.groupBy("doc_id").agg(F.count("*").alias("n")).join(full.groupBy("doc_id").agg(F.collect_set("bin").alias("full")), "doc_id", "left")
    empty = F.array_sort(F.array_except(F.sequence(F.lit(10), F.lit(89)), F.coalesce("full", F.array().cast("array<int>"))))
    runs = per.withColumn("empty", empty).select("doc_id", "n", F.transform("empty", lambda b, i: b - i).alias("keys"))
    count = F.size(F.filter(F.array_distinct("keys"), lambda k: F.size(F.filter(F.col("keys"), lambda x: x == k)) >= least))
    return runs.select("doc_id", F.when(F.col("n") < 6, 0).otherwise(count).cast("bigint").alias("n_gaps"))


def anchor_words(words: DataFrame) -> DataFrame:
    """doc_id, n_anchors: how many of the technical anchors occur within words."""
    seen = [F.max(F.lower("text").contains(a).cast("int")) for a in ANCHORS]
    return words.groupBy("doc_id").agg(sum(seen[1:], seen[0]).cast("bigint").alias("n_anchors"))


def routed(words: DataFrame, lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, table_type, ruled_score, kv_score, n_gaps, n_anchors."""
    w, d = in_table(words, tables, 0.5).select(*words.columns), lines
    out = tables.select("doc_id")
    for part in (ruled_scores(d, tables), kv_scores(w, tables), wide_gaps(w, tables), anchor_words(w)):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0)
    kind = F.when((F.col("n_anchors") >= 2) | (F.col("n_gaps") >= 2), "COMPLEX").when(F.col("ruled_score") > 0.4, "RULED").when(F.col("kv_score") > 0.8, "KV").otherwise("COMPLEX")
    return out.withColumn("table_type", kind)


def kv_cells(words: DataFrame, tables: DataFrame, tolerance: float = 5, header: float = 0.7) -> DataFrame:
    """doc_id, row_no, col_no, text, is_header: a row over `header` of the width is a header; others part at the column split; a row with right words only continues the value above."""
    split = column_split(words, tables)
    rows = row_groups(words, tolerance).join(split, "doc_id").join(tables, "doc_id")
    left = (F.col("x0") + F.col("x1")) / 2 < F.col("split")
    said = lambda when: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("x0", "word_idx", "text")))), lambda w: w["text"]), " ")
    wide = (F.max("x1") - F.min("x0")) / F.first(F.col("t_x1") - F.col("t_x0")) > header
    r = rows.groupBy("doc_id", "row_no").agg(wide.alias("is_header"), said(F.lit(True)).alias("whole"), said(left).alias("key"), said(~left).alias("value"))
    w = W.partitionBy("doc_id").orderBy("row_no")
    joins = ~F.col("is_header") & (F.col("key") == "") & (F.col("value") != "")
    # a row joins the last cell if that is a value, be it the row's own or itself a continuation
    valued = F.lag(~F.col("is_header") & (F.col("value") != "")).over(w)
    r = r.withColumns({"joins": joins, "valued": F.coalesce(valued, F.lit(False))})
    continued = F.col("joins") & F.col("valued")
    start = F.last(F.when(~continued, F.col("row_no")), ignorenulls=True).over(w)
    owned = r.withColumn("owner", start)
    no = F.dense_rank().over(W.partitionBy("doc_id").orderBy("owner")) - 1
    g = owned.groupBy("doc_id", "owner").agg(F.min_by("is_header", "row_no").alias("is_header"), F.min_by("whole", "row_no").alias("whole"), F.min_by("key", "row_no").alias("key"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("value") != "", F.struct("row_no", "value")))), lambda x: x["value"]), " ").alias("value"))
    g = g.withColumn("row_no", no)
    cells = F.when(F.col("is_header"), F.array(F.struct(F.lit(0).alias("c"), F.col("whole").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("c"), F.col("key").alias("t")), F.struct(F.lit(1).alias("c"), F.col("value").alias("t"))))
    return g.select("doc_id", "row_no", "is_header", F.explode(cells).alias("x")).where("x.t <> ''").select("doc_id", "row_no", F.col("x.c").alias("col_no"), F.col("x.t").alias("text"), "is_header")


def grid(boundaries_x: DataFrame, boundaries_y: DataFrame) -> DataFrame:
    """doc_id, row_no, col_no, x0..y1: cells between consecutive boundaries."""
    part = lambda df, name, lo, hi: df.select("doc_id", F.posexplode("boundaries").alias(name, lo), F.col("boundaries")).withColumn(hi, F.get("boundaries", F.col(name) + 1)).where(F.col(hi).isNotNull()).drop("boundaries")
    return part(boundaries_x, "col_no", "x0", "x1").join(part(boundaries_y, "row_no", "y0", "y1"), "doc_id")


def filled(cells: DataFrame, words: DataFrame) -> DataFrame:
    """cells with text and n_words: the words whose centres they hold, borders included, by top and left edge."""
    a, b = geo.renamed(cells, "c_"), geo.renamed(words, "w_")
    p = a.join(b, (F.col("c_doc_id") == F.col("w_doc_id")) & geo.centre_in("w_", "c_"), "left")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("w_word_idx").isNotNull(), F.struct("w_y0", "w_x0", "w_word_idx", "w_text")))), lambda w: w["w_text"]), " ")
    return p.groupBy(F.col("c_doc_id").alias("doc_id"), F.col("c_row_no").alias("row_no"), F.col("c_col_no").alias("col_no")).agg(said.alias("text"), F.count("w_word_idx").alias("n_words"))


def table_quality(cells: DataFrame, words: DataFrame, least: float = 0.7, most_twice: float = 0.05, sane: float = 0.8) -> DataFrame:
    """doc_id, coverage, duplication, row_sanity, empty_ratio, passed of (doc_id, row_no, col_no, text, word_ids) cells against all words."""
    used = cells.select("doc_id", F.explode("word_ids").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("used"), F.count_if(F.col("n") > 1).alias("twice"))
    all_words = words.groupBy("doc_id").agg(F.count("*").alias("words"))
    shape = row_sanity(cells).join(cells.groupBy("doc_id").agg(F.avg((strip(F.col("text")) == "").cast("double")).alias("empty_ratio")), "doc_id")
    q = shape.join(all_words, "doc_id", "left").join(used, "doc_id", "left").fillna(0, ["words", "used", "twice"])
    cover = F.when(F.col("words") > 0, F.col("used") / F.col("words")).otherwise(1.0)
    again = F.when(F.col("used") > 0, F.col("twice") / F.col("used")).otherwise(0.0)
    q = q.select("doc_id", cover.alias("coverage"), again.alias("duplication"), "row_sanity", "empty_ratio")
    return q.withColumn("passed", (F.col("coverage") >= least) & (F.col("duplication") <= most_twice) & (F.col("row_sanity") >= sane))


def extractor_quality(cells: DataFrame, words: DataFrame, method: Column) -> DataFrame:
    """doc_id, method, coverage, duplication, empty_ratio, passed by the extractors' own limits; empty cells count for ruled tables only."""
    q = table_quality(cells, words).withColumn("method", method).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    q = q.withColumn("empty_ratio", F.when(F.col("method") == "ruled", F.col("empty_ratio")).otherwise(0.0))
    return q.withColumn("passed", (F.col("coverage") >= 0.9) & (F.col("duplication") <= 0.02) & (F.col("empty_ratio") <= 0.5)).drop("row_sanity")


def row_sanity(cells: DataFrame) -> DataFrame:
    """doc_id, row_sanity: share of rows that have the most common number of cells."""
    per = cells.groupBy("doc_id", "row_no").agg(F.count("*").alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("k"))
    return per.groupBy("doc_id").agg((F.max("k") / F.sum("k")).alias("row_sanity"))


def next_action(passed: Column, coverage: Column, duplication: Column, sanity: Column, method: Column) -> Column:
    """accept, or the strategy to run next."""
    return (
        F.when(passed, "accept").when(coverage < 0.5, F.when(method.contains("kv"), "rerun:tsr").otherwise("rerun:kv"))
        .when(duplication > 0.1, "rerun:ruled").when(sanity < 0.8, "rerun:tsr").otherwise("escalate:tsr")
    )


def dense_rows(cells: DataFrame) -> DataFrame:
    """doc_id, rows: array of arrays of texts, "" where there is no cell."""
    size = cells.groupBy("doc_id").agg(F.max("row_no").alias("r"), F.max("col_no").alias("c"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "row_no", "col_no"), "text"))).alias("m"))
    at = lambda r, c: F.coalesce(F.try_element_at("m", F.concat_ws(":", r.cast("string"), c.cast("string"))), F.lit(""))
    return size.select("doc_id", F.transform(F.sequence(F.lit(0), "r"), lambda r: F.transform(F.sequence(F.lit(0), F.col("c")), lambda c: at(r, c))).alias("rows"))


def markdown(rows: Column) -> Column:
    """A Markdown table: rows cut or filled to the (truncated) median length, first row as header."""
    lengths = F.array_sort(F.transform(rows, F.size))
    n = F.size(lengths)
    median = F.floor((F.get(lengths, F.floor((n - 1) / 2).cast("int")) + F.get(lengths, F.floor(n / 2).cast("int"))) / 2).cast("int")
    escaped = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), median - 1), lambda i: escaped(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), median), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    return F.when((n == 0) | (median <= 0), "").otherwise(F.array_join(F.concat(F.array(F.get(body, F.lit(0)), rule), F.slice(body, 2, F.greatest(n - 1, F.lit(0)))), "\n"))


def valid_table(cells: DataFrame, most_empty: float = 0.8, least: int = 2) -> DataFrame:
    """doc_id, valid: enough cells that are neither empty nor placeholders."""
    t = strip(F.coalesce("text", F.lit("")))
    c = cells.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(t == "").alias("empty"), F.count_if((t != "") & t.rlike(PLACEHOLDER)).alias("held"))
    return c.select("doc_id", (((F.col("empty") + F.col("held")) / F.col("n") <= most_empty) & (F.col("n") - F.col("empty") - F.col("held") >= least)).alias("valid"))


def refined_box(words: DataFrame, tables: DataFrame, margin: float = 2, keep: tuple[float, float, float] = (0.55, 0.78, 0.60)) -> DataFrame:
    """doc_id, x0..y1: the union of words with 0.3 or more in the table, with a margin; the first box where too little is left, or its sides where an axis shrank too much."""
    inside = in_table(words, tables, 0.3)
    u = inside.groupBy("doc_id").agg(F.min("x0").alias("u0"), F.min("y0").alias("v0"), F.max("x1").alias("u1"), F.max("y1").alias("v1"))
    j = tables.join(u, "doc_id", "left")
    b = j.select("doc_id", *[f"t_{s}" for s in geo.SIDES], (F.coalesce("u0", "t_x0") - margin).alias("a0"), (F.coalesce("v0", "t_y0") - margin).alias("b0"), (F.coalesce("u1", "t_x1") + margin).alias("a1"), (F.coalesce("v1", "t_y1") + margin).alias("b1"))
    w, h, tw, th = F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"), F.col("t_x1") - F.col("t_x0"), F.col("t_y1") - F.col("t_y0")
    whole = w * h < tw * th * keep[0]
    narrow, low = whole | (w < tw * keep[1]), whole | (h < th * keep[2])
    pick = lambda bad, old, new: F.when(bad, F.col(old)).otherwise(F.col(new))
    return b.select("doc_id", pick(narrow, "t_x0", "a0").alias("x0"), pick(low, "t_y0", "b0").alias("y0"), pick(narrow, "t_x1", "a1").alias("x1"), pick(low, "t_y1", "b1").alias("y1"))


def cells_of_tags(text: Column) -> Column:
    """array<array<string>> of a model's answer: <ROW> parts with <P>, <C> and <V> tags, else pipe rows."""
    tag = lambda r, t: F.trim(F.regexp_extract(r, f"(?s)<{t}>(.*?)</{t}>", 1))
    tagged = F.transform(F.regexp_extract_all(text, F.lit("(?s)<ROW>(.*?)</ROW>"), F.lit(1)), lambda r: F.array(tag(r, "P"), tag(r, "C"), tag(r, "V")))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^[|\s:-]+$"))
    piped = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return F.when(F.size(tagged) > 0, tagged).otherwise(piped)
