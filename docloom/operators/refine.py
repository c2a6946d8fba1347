"""Smaller steps around tables, captions and extraction: what to keep, where to look, what to try next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.functions.text import CURRENCY_SIGNS, is_empty, strip
from docloom.operators.regions import pairs

# Names that tell of one domain, spellings, cues of document kinds.
TELLTALES = {
    "industrial": ("art_no", "article_no", "article_number", "manufacturer", "serial_series", "lot_serial_series", "pinout", "pin_assignment", "connectors", "diagnostics", "supply_voltage"),
    "logistics": ("quote_no", "quote_number", "port_of_loading", "port_of_discharge", "bill_of_lading", "freight", "surcharge", "bunker", "haulage", "tariff"),
    "invoice": ("bill_to", "ship_to", "unit_price", "grand_total", "subtotal", "line_items", "invoice_no", "invoice_number"),
    "medical_record": ("patient", "diagnosis", "prescription", "physician", "icd10"),
}
SPELLINGS = {"mechnaical": "mechanical", "mechnical": "mechanical", "mechanicalcal": "mechanical", "electrial": "electrical", "electricalal": "electrical", "enviromental": "environmental", "enviornmental": "environmental", "logisitical": "logistical", "logistic": "logistical"}
PARAM_TYPES = ("electrical", "mechanical", "environmental", "logistical")
PARAM_UNITS = {"voltage": ("V", "VAC", "VDC"), "current": ("A", "mA"), "frequency": ("Hz", "kHz", "MHz"), "temperature": ("°C", "C", "°F", "F")}
SUPPLIER = ("from:", "supplier:", "vendor:", "manufacturer:", "company:", "seller:")
RECIPIENT = ("to:", "customer:", "recipient:", "client:", "buyer:", "ship to:")
TITLES = (
    ("Technical Quotation", "quotation|quote|estimate|tender|bid"), ("Invoice", "invoice|bill|receipt|account"), ("Technical Specification", "specification|spec|datasheet|technical data|pdf417"),
    ("Purchase Order", "purchase order|order confirmation"), ("Technical Documentation", "manual|guide|technical|documentation"),
)


def structure_cells(parts: DataFrame) -> DataFrame:
    """doc_id, row_no, col_no, x0..y1, confidence, is_header of detected (doc_id, kind row|column|header, box, score): each row with each column it crosses. Boxes of one corner and score count by their far corner, so numbers do not depend on how rows are dealt; nulls come last."""
    place = lambda *order: F.row_number().over(W.partitionBy("doc_id").orderBy(*[F.asc_nulls_last(c) for c in (*order, "score", "y1", "x1")])) - 1
    rows = parts.where("kind = 'row'").withColumn("row_no", place("y0", "x0"))
    cols = parts.where("kind = 'column'").withColumn("col_no", place("x0", "y0"))
    r, c = geo.renamed(rows, "r_"), geo.renamed(cols, "c_")
    p = r.join(c, F.col("r_doc_id") == F.col("c_doc_id")).select(
        F.col("r_doc_id").alias("doc_id"), F.col("r_row_no").alias("row_no"), F.col("c_col_no").alias("col_no"), F.greatest("r_x0", "c_x0").alias("x0"), F.greatest("r_y0", "c_y0").alias("y0"),
        F.least("r_x1", "c_x1").alias("x1"), F.least("r_y1", "c_y1").alias("y1"), F.least("r_score", "c_score").alias("confidence"),
    ).where("x1 > x0 and y1 > y0")
    head = geo.renamed(parts.where("kind = 'header'"), "h_")
    in_head = p.join(head, (F.col("doc_id") == F.col("h_doc_id")) & ((F.col("x0") + F.col("x1")) / 2).between(F.col("h_x0"), F.col("h_x1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("h_y0"), F.col("h_y1")), "left_semi").select("doc_id", "row_no", "col_no").withColumn("__h", F.lit(True))
    return p.join(in_head, ["doc_id", "row_no", "col_no"], "left").withColumn("is_header", (F.col("row_no") == 0) | F.coalesce("__h", F.lit(False))).drop("__h")


def row_structure(words: DataFrame, splits: DataFrame) -> DataFrame:
    """doc_id, bonus of (doc_id, row_no, x0, x1) words: share of rows with words on both sides of the split; 0 with fewer than two rows."""
    w = words.join(splits.select("doc_id", "split"), "doc_id").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    rows = w.groupBy("doc_id", "row_no").agg((F.bool_or(F.col("cx") < F.col("split")) & F.bool_or(F.col("cx") > F.col("split"))).alias("both"))
    return rows.groupBy("doc_id").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.count_if("both") / F.count("*")).alias("bonus"))


def relationships(texts: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, page, region_idx, relation: inside_figure over 0.7 IoU, caption below a figure that it overlaps little, else separate."""
    p = pairs(texts, figures, "left").withColumn("iou", F.coalesce(geo.iou("a_", "b_"), F.lit(0.0)))
    level = F.when(F.col("iou") > 0.7, 2).when((F.col("iou") > 0.1) & (F.col("iou") < 0.7) & (F.col("a_y0") > F.col("b_y1")), 1).otherwise(0)
    best = p.groupBy(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("region_idx")).agg(F.max(level).alias("l"))
    return best.select("doc_id", "page", "region_idx", F.when(F.col("l") == 2, "inside_figure").when(F.col("l") == 1, "caption").otherwise("separate").alias("relation"))


def expanded(lines: DataFrame, tables: DataFrame, near: float = 5) -> DataFrame:
    """doc_id, x0..y1: a table's box grown, line after line in order, by horizontal and vertical lines at its edges."""
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    row = F.struct("line_idx", geo.horizontal().alias("h"), "x0", "y0", "x1", "y1")
    use = lines.where((F.col("kind") == "line") & (geo.horizontal() | geo.vertical()))
    listed = use.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("ls"))

    def step(b: Column, d: Column) -> Column:
        """One line: p is its place across, a and z its ends along."""
        h = d["h"]
        p, a, z = F.when(h, d["y0"]).otherwise(d["x0"]), F.when(h, F.least(d["x0"], d["x1"])).otherwise(F.least(d["y0"], d["y1"])), F.when(h, F.greatest(d["x0"], d["x1"])).otherwise(F.greatest(d["y0"], d["y1"]))
        along0, along1 = F.when(h, b["x0"]).otherwise(b["y0"]), F.when(h, b["x1"]).otherwise(b["y1"])
        across0, across1 = F.when(h, b["y0"]).otherwise(b["x0"]), F.when(h, b["y1"]).otherwise(b["x1"])
        first, last = F.abs(p - across0) < near, F.abs(p - across1) < near
        touch = first | last
        n0 = F.when(touch & (a < along0) & (z > along0), a).otherwise(along0)
        n1 = F.when(touch & (z > along1) & (a < along1), z).otherwise(along1)
        m0, m1 = F.when(first, F.least(across0, p)).otherwise(across0), F.when(last, F.greatest(across1, p)).otherwise(across1)
        pick = lambda x, y: F.when(h, x).otherwise(y)
        return F.struct(pick(n0, m0).alias("x0"), pick(m0, n0).alias("y0"), pick(n1, m1).alias("x1"), pick(m1, n1).alias("y1")).cast(kind)

    start = F.struct(F.col("t_x0").alias("x0"), F.col("t_y0").alias("y0"), F.col("t_x1").alias("x1"), F.col("t_y1").alias("y1")).cast(kind)
    every = tables.join(listed, "doc_id", "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<struct<line_idx:int,h:boolean,x0:double,y0:double,x1:double,y1:double>>")))
    return every.select("doc_id", F.aggregate("ls", start, step).alias("b")).select("doc_id", "b.*")


def accepted(first: DataFrame, second: DataFrame) -> DataFrame:
    """doc_id, method, coverage, passed: a table's first quality, let off where only duplication fails slightly, or a second try that covers more.

    first and second: doc_id, table_type, method, coverage, duplication, row_sanity, passed.
    """
    j = first.join(second.select("doc_id", F.col("method").alias("m2"), F.col("coverage").alias("c2"), F.col("passed").alias("p2")), "doc_id", "left")
    slight = (F.col("table_type") == "COMPLEX") & (F.col("coverage") >= 0.95) & (F.col("duplication") > 0.05) & (F.col("duplication") <= 0.08) & (F.col("row_sanity") >= 0.8)
    good = F.col("passed") | slight
    retry = ~good & (F.coalesce("c2", F.lit(-1.0)) > F.col("coverage"))
    return j.select("doc_id", F.when(retry, F.concat("m2", F.lit("_retry"))).otherwise(F.col("method")).alias("method"), F.when(retry, F.col("c2")).otherwise(F.col("coverage")).alias("coverage"), F.when(retry, F.col("p2")).otherwise(good).alias("passed"))


def anchor_text(text: Column, y0: Column, y1: Column, table_top: Column) -> Column:
    """The line of a text block nearest to a table's top, and the next descriptive one within reach."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")

    def pick(ls: Column) -> Column:
        n = F.size(ls)
        height = (y1 - y0) / n
        placed = F.transform(ls, lambda x, i: F.struct(F.abs(y0 + (i + 0.5) * height - table_top).alias("d"), i.alias("i"), x.alias("x")))
        best = F.array_min(placed)
        after = F.filter(placed, lambda p: (p["i"] > best["i"]) & (F.abs(p["d"] - best["d"]) <= 100) & (F.length(p["x"]) >= 3) & ~p["x"].startswith("Pin"))
        return F.when(n == 0, None).when(n == 1, F.get(ls, F.lit(0))).otherwise(F.concat_ws("\n", best["x"], F.get(after, F.lit(0))["x"]))

    return F.element_at(F.transform(F.array(lines), pick), 1)


def inconsistent(skeletons: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, hits: proposed schemas (doc_id, domain, confidence, names) whose names tell of another domain than a confident vocabulary."""
    told = F.array().cast("array<string>")
    for other, names in TELLTALES.items():
        told = F.array_union(told, F.when(F.col("domain") == other, F.array().cast("array<string>")).otherwise(F.array_intersect("names", F.array(*[F.lit(n) for n in names]))))
    return skeletons.where((F.col("confidence") >= least) & ~F.col("domain").isin("", "general")).select("doc_id", F.array_sort(told).alias("hits")).where(F.size("hits") > 0)


def windows(found: DataFrame, size: Column, reach: int = 400, most: int = 3) -> DataFrame:
    """doc_id, start, stop: windows about the first `most` places of (doc_id, pos), one for each pair of hundreds."""
    first = found.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).where(F.col("__n") <= most)
    w = first.select("doc_id", "pos", F.greatest(F.lit(0), F.col("pos") - reach).alias("start"), F.least(size, F.col("pos") + reach).alias("stop"))
    return w.groupBy("doc_id", F.floor(F.col("start") / 100).alias("__a"), F.floor(F.col("stop") / 100).alias("__b")).agg(F.min_by(F.struct("start", "stop"), "pos").alias("w")).select("doc_id", "w.start", "w.stop")


def currency_of(currency: Column, *money: Column) -> Column:
    """A blank currency filled from the sign in the first money field that has one."""
    found = []
    for m in money:
        sign = F.when(F.lit(False), "")
        for s, code in CURRENCY_SIGNS:
            sign = sign.when(m.contains(s), code)
        found.append(sign)
    return F.when(~is_empty(currency), currency).otherwise(F.coalesce(*found))


def param_type(raw: Column) -> Column:
    """A parameter's type with known misspellings and doubled endings put right."""
    k = F.lower(F.trim(raw))
    out = F.when(F.lit(False), "")
    for wrong, right in SPELLINGS.items():
        out = out.when(k == wrong, right)
    out = out.when(k.isin(*PARAM_TYPES), raw)
    for t in PARAM_TYPES:
        out = out.when(k.startswith(t), t)
    return out.otherwise(raw)


def unit_for(kind: Column, value: Column) -> Column:
    """The first unit of a parameter's kind that its value contains."""
    out = F.when(F.lit(False), "")
    for k, units in PARAM_UNITS.items():
        for u in units:
            out = out.when((kind == k) & value.contains(u), u)
    return out


def named_after(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """doc_id, found: what follows the first line with one of the words: after its colon, or the next line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    near = lines.withColumn("next", strip(F.lead("line").over(W.partitionBy("doc_id").orderBy("i"))))
    has = F.lower("line").rlike("|".join(words))
    after = strip(F.regexp_replace("line", r"^[^:]*:", ""))
    said = F.when(F.length(after) > 2, after).when(F.length("next") > 2, F.col("next"))
    return near.where(has).withColumn("said", said).where("said is not null").groupBy("doc_id").agg(F.min_by("said", "i").alias("found"))


def title_of(text: Column) -> Column:
    """The kind of document that the first fitting vocabulary says."""
    out = F.when(F.lit(False), "")
    for title, words in TITLES:
        out = out.when(F.lower(text).rlike(words), title)
    return out.otherwise("Technical Document")


def retry_prompt(path: Column, value: Column, source: Column) -> Column:
    """What a model is asked for one field."""
    name = F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"\[.*", "")
    parent = F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("<root>")
    state = F.when(is_empty(value), F.lit("No value was found before.")).otherwise(F.concat(F.lit("The value "), value, F.lit(" is suspect.")))
    return F.concat(F.lit("Copy one value from the source, verbatim, on one line; null if it is not there.\nField: "), name, F.lit("\nWithin: "), parent, F.lit("\n"), state, F.lit("\nSource:\n"), source)


def extraction_status(batches: DataFrame) -> DataFrame:
    """doc_id, route, status, n_ok, n_batches of (doc_id, chars, ok): direct for one short batch; failed where no batch gave data."""
    s = batches.groupBy("doc_id").agg(F.count("*").alias("n_batches"), F.count_if("ok").alias("n_ok"), F.sum("chars").alias("chars"))
    return s.select("doc_id", F.when((F.col("n_batches") == 1) & (F.col("chars") < 4000), "direct").otherwise("batched").alias("route"), F.when(F.col("n_ok") > 0, "success").otherwise("failed").alias("status"), "n_ok", "n_batches")


def smoke(record: DataFrame, meta: tuple[str, ...] = ("confidence_score", "reasoning_thoughts", "page_references", "status", "error", "details")) -> DataFrame:
    """doc_id, passed: whether any field but the bookkeeping ones is filled."""
    return record.groupBy("doc_id").agg(F.bool_or(~is_empty(F.col("value")) & ~F.element_at(F.split("path", r"\."), 1).isin(*meta)).alias("passed"))
