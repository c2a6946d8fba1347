"""Filters, suppression and order of a page's regions.

Regions are rows of doc_id, page, region_idx, type, x0, y0, x1, y1 and what an operator names
besides. Joins of boxes carry doc_id and page as equal keys, so that they are dealt by page; folds
run over the sorted array of one page's regions inside the JVM. A page with few thousand regions
is the unit of work; documents with very many pages spread over many partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.functions.text import is_upper, strip
from docloom.operators.paged import by_page, carried

PAGE = ["doc_id", "page"]
KEY = [*PAGE, "region_idx"]
# Parts of detector labels, in the order in which they decide.
LABEL_PARTS = (
    ("title", ("title", "main_title", "doc_title")), ("heading", ("heading", "sub_heading", "section", "h1", "h2", "h3")), ("table", ("table", "spreadsheet", "data_grid")),
    ("figure", ("figure", "image", "picture", "graphic", "chart")), ("caption", ("caption", "legend", "fig_note")), ("footer", ("footer", "page_footer", "page_number")),
    ("header", ("header", "page_header", "running_title")),
)
TYPES = ("title", "heading", "text", "table", "figure", "caption", "footer", "header")
SPANNING = ("text", "list", "title", "heading", "caption")
MODEL_SOURCES = ("layout_model", "ensemble")


def region_type(label: Column) -> Column:
    """A region type for any detector label: itself, else by the parts it contains, else text."""
    raw = F.lower(F.trim(label))
    out = F.when(raw.isin(*TYPES), raw)
    for kind, parts in LABEL_PARTS:
        out = out.when(raw.rlike("|".join(parts)), kind)
    return out.otherwise("text")


def detector_label(label: Column) -> Column:
    """Text, Caption, or the label with capitals."""
    raw = F.lower(label)
    return F.when(raw == "text", "Text").when(raw.contains("caption"), "Caption").otherwise(F.initcap(label))


def promoted(kind: Column, text: Column, size: Column, bold: Column) -> Column:
    """Text that its font or capitals make a title or heading."""
    t = strip(text)
    new = F.when(t == "", None).when(bold & (size >= 14), "title").when(bold & (size >= 11), "heading").when(is_upper(t) & (F.length(t) > 3) & (F.length(t) < 80), "heading")
    return F.when(kind == "text", F.coalesce(new, kind)).otherwise(kind)


def pairs(left: DataFrame, right: DataFrame, how: str = "inner", when: Column | None = None) -> DataFrame:
    """left as a_*, right as b_*, of the same page, joined on equal page keys and `when`."""
    a, b = geo.renamed(left, "a_"), geo.renamed(right, "b_")
    on = (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("a_page") == F.col("b_page"))
    return a.join(b, on if when is None else on & when, how)


def back(df: DataFrame, columns: list[str], prefix: str = "a_") -> DataFrame:
    return df.select(*[F.col(prefix + c).alias(c) for c in columns])


def drop_swallowing_figures(regions: DataFrame, share: float = 0.8) -> DataFrame:
    """Without figures that hold `share` or more of any table of their page."""
    tables = regions.where(F.col("type") == "table")
    when = (F.col("a_type") == "figure") & (geo.contained("b_", "a_") >= share)
    return back(pairs(regions, tables, "left_anti", when), regions.columns)


def drop_table_spanners(regions: DataFrame, least: int = 2) -> DataFrame:
    """Without text-like regions that reach over more than a tenth of the height of `least` tables."""
    reach = F.least(F.col("a_y1"), F.col("b_y1")) - F.greatest(F.col("a_y0"), F.col("b_y0"))
    when = F.col("a_type").isin(*SPANNING) & (reach > 0) & (reach > geo.height("b_") * 0.1)
    spanned = back(pairs(regions, regions.where(F.col("type") == "table"), "inner", when), KEY).groupBy(*KEY).count().where(F.col("count") >= least)
    return regions.join(spanned.select(*KEY), KEY, "left_anti").select(*regions.columns)


def drop_occupied_text(regions: DataFrame, most: float = 0.5) -> DataFrame:
    """Without native text of which figures and tables together cover more than `most`; text without area goes too."""
    native = regions.where((F.col("source") == "native_pdf") & (F.col("type") == "text"))
    rest = regions.where(~((F.col("source") == "native_pdf") & (F.col("type") == "text")))
    held = rest.where(F.col("type").isin("table", "figure"))
    covered = pairs(native, held, "inner", geo.intersection("a_", "b_") > 0).groupBy(*[f"a_{c}" for c in KEY]).agg(F.sum(geo.intersection("a_", "b_")).alias("covered"))
    kept = native.join(covered.select(*[F.col(f"a_{c}").alias(c) for c in KEY], "covered"), KEY, "left")
    return kept.where((geo.area() > 0) & (F.coalesce("covered", F.lit(0.0)) / geo.area() <= most)).select(*regions.columns).unionByName(rest)


def clean_regions(regions: DataFrame, most: float = 0.5) -> DataFrame:
    """Model regions and others as they are; native ones unless a model region holds more than `most` of them or has their text."""
    native, model = regions.where(F.col("source") == "native_pdf"), regions.where(F.col("source").isin(*MODEL_SOURCES))
    others = regions.where((F.col("source") != "native_pdf") | F.col("source").isNull())
    free = back(pairs(native, model, "left_anti", geo.contained("a_", "b_") > most), regions.columns)
    texts = model.where(F.length("text") > 0).select(*PAGE, F.trim("text").alias("same")).distinct()
    return free.withColumn("same", F.trim(F.coalesce("text", F.lit("")))).join(texts, [*PAGE, "same"], "left_anti").select(*regions.columns).unionByName(others)


_BOX = "struct<region_idx:int,x0:double,y0:double,x1:double,y1:double,conf:double,type:string,models:array<string>>"


def _overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _size(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def _iou(a: Column, b: Column) -> Column:
    both = _overlap(a, b)
    union = _size(a) + _size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def _ranked(regions: DataFrame) -> DataFrame:
    """Each page's regions as one array, by confidence and area descending, then as they stand."""
    row = F.struct((-F.col("conf")).alias("c"), (-geo.area()).alias("a"), "region_idx", F.struct("region_idx", "x0", "y0", "x1", "y1", "conf", "type", F.array("source").alias("models")).cast(_BOX).alias("r"))
    return regions.groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("rs"))


def suppress(regions: DataFrame, most: float, inclusive: bool = False) -> DataFrame:
    """Greedy suppression: a region stays if its IoU with each kept one is at most `most` (below it, if inclusive)."""
    hit = (lambda a, b: _iou(a, b) >= most) if inclusive else (lambda a, b: _iou(a, b) > most)
    side = "struct<x0:double,y0:double,x1:double,y1:double>"
    start = F.struct(F.array().cast(f"array<{side}>").alias("kept"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        over = F.exists(s["kept"], lambda k: hit(k, r))
        box = F.struct(*[r[c].alias(c) for c in geo.SIDES])
        return F.struct(F.when(over, s["kept"]).otherwise(F.concat(s["kept"], F.array(box))).alias("kept")), F.struct((~over).alias("__keep"))

    ranked = regions.withColumns({"__c": -F.col("conf"), "__a": -geo.area()})
    return carried(ranked, PAGE, ["__c", "__a", "region_idx"], start, step, f"struct<kept:array<{side}>>", "struct<__keep:boolean>").where("__keep").select(*regions.columns)


def merge_detections(regions: DataFrame, most: float = 0.3, inside: float = 0.8) -> DataFrame:
    """doc_id, page, region_idx, x0..y1, type, conf, models, merged: overlapping detections as one.

    A seed, by confidence and area, takes up the remaining ones with IoU over `most` or more than
    `inside` of them within it; it keeps its box; a caption yields its label to a surer title, text
    or table. Suppression at `most` follows.
    """
    kind = f"struct<left:array<{_BOX}>,out:array<{_BOX}>>"
    start = F.struct(F.col("rs").alias("left"), F.array().cast(f"array<{_BOX}>").alias("out")).cast(kind)

    def takes(seed: Column, r: Column) -> Column:
        share = F.when(_size(r) > 0, _overlap(seed, r) / _size(r)).otherwise(0.0)
        return (_iou(seed, r) > most) | (share > inside)

    def step(acc: Column, seed: Column) -> Column:
        here = F.exists(acc["left"], lambda x: x["region_idx"] == seed["region_idx"])
        others = F.filter(acc["left"], lambda x: x["region_idx"] != seed["region_idx"])
        taken = F.filter(others, lambda x: takes(seed, x))
        better = F.get(F.filter(taken, lambda x: x["type"].isin("title", "text", "table") & (x["conf"] > 0.7)), F.lit(0))
        best = F.when((seed["type"] == "caption") & better.isNotNull(), better).otherwise(seed)
        many = F.size(taken) > 0
        models = F.array_sort(F.array_distinct(F.concat(seed["models"], F.flatten(F.transform(taken, lambda x: x["models"])))))
        row = F.struct(
            seed["region_idx"].alias("region_idx"), seed["x0"].alias("x0"), seed["y0"].alias("y0"), seed["x1"].alias("x1"), seed["y1"].alias("y1"),
            best["conf"].alias("conf"), best["type"].alias("type"), F.when(many, models).otherwise(seed["models"]).alias("models"),
        ).cast(_BOX)
        rest = F.filter(others, lambda x: ~takes(seed, x))
        return F.when(here, F.struct(rest.alias("left"), F.concat(acc["out"], F.array(row)).alias("out")).cast(kind)).otherwise(acc)

    merged = F.aggregate("rs", start, step, lambda a: a["out"])
    flat = _ranked(regions).select(*PAGE, F.explode(merged).alias("m")).select(*PAGE, "m.*").withColumn("source", F.element_at("models", 1))
    return suppress(flat, most).select(*KEY, *geo.SIDES, "type", "conf", "models")


def reading_order(regions: DataFrame, page_width: float = 612) -> DataFrame:
    """regions with read_no and region_id: by top edge; on ties left column, right column, full width."""
    lane = F.when(geo.width() > page_width * 0.6, 2).when((F.col("x0") + F.col("x1")) / 2 < page_width / 2, 0).otherwise(1)
    no = F.row_number().over(W.partitionBy(*PAGE).orderBy("y0", lane, "region_idx")) - 1
    return regions.withColumn("read_no", no).withColumn("region_id", F.format_string("p%d_r%d", "page", "read_no"))


def widest_gap(regions: DataFrame, axis: str, least: float) -> DataFrame:
    """doc_id, page, gap, split: the widest gap, of `least` or more, between the boxes' merged projections; the first of equals."""
    a, b = f"{axis}0", f"{axis}1"
    w = W.partitionBy(*PAGE).orderBy(a, b, "region_idx")
    ends = regions.withColumn("reach", F.max(b).over(w.rowsBetween(W.unboundedPreceding, -1)))
    gaps = ends.where(F.col(a) - F.col("reach") >= least).where(F.col(a) > F.col("reach"))
    best = gaps.groupBy(*PAGE).agg(F.max_by(F.struct("reach", a), F.struct(F.col(a) - F.col("reach"), -F.col(a))).alias("g"))
    return best.select(*PAGE, (F.col(f"g.{a}") - F.col("g.reach")).alias("gap"), ((F.col(f"g.{a}") + F.col("g.reach")) / 2).alias("split"))


def xy_cut(regions: DataFrame, least_x: float = 10, least_y: float = 2, column_gap: float = 35, column_first: bool = False) -> DataFrame:
    """regions' keys with read_no by recursive cuts at the widest gaps, columns first where their gap is clear."""

    def gap(low: np.ndarray, high: np.ndarray, least: float) -> tuple[float, float | None]:
        order = np.lexsort((high, low))
        a, b = low[order], high[order]
        reach = np.maximum.accumulate(b)[:-1]
        gaps = a[1:] - reach
        fit = (gaps > 0) & (gaps >= least)
        if not fit.any():
            return 0.0, None
        k = int(np.where(fit, gaps, -1.0).argmax())
        return float(gaps[k]), float((a[k + 1] + reach[k]) / 2)

    def order(at: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[int]:
        todo, out = [at], []
        while todo:
            at = todo.pop()
            gx, sx = gap(x0[at], x1[at], least_x) if len(at) > 1 else (0.0, None)
            gy, sy = gap(y0[at], y1[at], least_y) if len(at) > 1 else (0.0, None)
            by_x = sx is not None and (sy is None or gx > (15 if column_first else column_gap))
            if sx is None and sy is None:
                out += at[np.lexsort((x0[at], y0[at]))].tolist()
                continue
            first = (x0[at] + x1[at]) / 2 < sx if by_x else (y0[at] + y1[at]) / 2 < sy
            if first.all() or not first.any():
                out += at[np.lexsort((x0[at], y0[at]))].tolist()
            else:
                todo += [at[~first], at[first]]
        return out

    def page(ids: np.ndarray, *sides: np.ndarray) -> tuple:
        return ids[order(np.arange(len(ids)), *sides)], range(len(ids))

    return by_page(regions, ["region_idx"], page, ["region_idx", *geo.SIDES], "region_idx int, read_no int", ["region_idx", "read_no"])


def page_stats(regions: DataFrame) -> DataFrame:
    """doc_id, page, type, n."""
    return regions.groupBy(*PAGE, "type").agg(F.count("*").alias("n"))


def document_summary(regions: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_regions, n_tables, n_figures, native share of the regions."""
    return regions.groupBy("doc_id").agg(
        F.countDistinct("page").alias("n_pages"), F.count("*").alias("n_regions"), F.count_if(F.col("type") == "table").alias("n_tables"),
        F.count_if(F.col("type") == "figure").alias("n_figures"), F.round(F.avg((F.col("source") == "native_pdf").cast("double")), 6).alias("native_share"),
    )


def pages_of(text: str, last: int) -> list[int]:
    """Page numbers of a range such as 1-3,5, from 1, without doubles, sorted, up to the last page."""
    found: set[int] = set()
    for part in text.split(","):
        ends = [int(x) for x in part.strip().split("-") if x.strip()]
        if ends:
            found.update(range(ends[0], ends[-1] + 1))
    return sorted(p for p in found if 1 <= p <= last)
