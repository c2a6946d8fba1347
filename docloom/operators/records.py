"""Records as leaves (doc_id, batch_idx, path, value): merged, projected, verified, retried.

A record's leaves are rows, so merging is aggregation, projection a pivot over fixed names, and
verification a join with the source text.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import ascii_rule, comparable, is_empty, strip

SKIPPED = ("reasoning_thoughts", "page_references", "source_evidence", "confidence_score", "status", "error", "details")
SET_FIELDS = ("page_references", "standards", "key_points")


def merged(fields: DataFrame, order: str = "batch_idx", tie: str = "k") -> DataFrame:
    """doc_id, path, value: the first value that is not empty, over batches in order."""
    kept = fields.where(~is_empty(F.col("value")))
    return kept.groupBy("doc_id", "path").agg(F.min_by("value", F.struct(order, tie, "value")).alias("value"))


def merged_lists(fields: DataFrame, order: str = "batch_idx", tie: str = "k") -> DataFrame:
    """doc_id, path, items: values of all batches in order; of set fields each once."""
    kept = fields.where(F.col("value").isNotNull()).groupBy("doc_id", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, tie, "value"))), lambda r: r["value"]).alias("items"))
    return kept.withColumn("items", F.when(F.col("path").isin(*SET_FIELDS), F.array_distinct("items")).otherwise(F.col("items")))


def first_by_name(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows without later ones of a name in a document; unnamed rows stay."""
    w = W.partitionBy("doc_id", name).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | is_empty(F.col(name))).drop("__n")


def first_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: lines of a text, each first time only (compared without outer blanks)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(strip(F.col("line")) != "")
    return lines.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", strip(F.col("line"))).orderBy("pos"))).where("__n = 1").drop("__n")


def projected(record: DataFrame, inferred: DataFrame, targets: dict[str, str]) -> DataFrame:
    """One column for each target (name to default): the record's value, else the inferred one, else the default.

    record and inferred: doc_id, path, value.
    """
    wide = lambda df: df.groupBy("doc_id").pivot("path", list(targets)).agg(F.first("value"))
    a, b = wide(record), wide(inferred).withColumnsRenamed({t: f"i_{t}" for t in targets})
    full = lambda c: F.when(~is_empty(F.col(f"`{c}`")), F.col(f"`{c}`"))
    return a.join(b, "doc_id", "full").select("doc_id", *[F.coalesce(full(t), full(f"i_{t}"), F.lit(d)).alias(t.replace(".", "_")) for t, d in targets.items()])


def inferred(docs: DataFrame) -> DataFrame:
    """doc_id, path, value: numbers, currency and names that patterns find in a text."""
    t = F.col("text")
    got = lambda rx, g=1: F.regexp_extract(t, rx, g)
    found = {
        "quotation_number": got(r"(?i)quotation\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*\d)"), "invoice_number": got(r"(?i)invoice\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*\d)"),
        "currency": got(r"\b(USD|EUR|GBP|INR|JPY|CNY|MXN|BRL|AUD|CAD|CHF|SGD)\b"), "product_name": got(r"(?i)product(?:\s+name)?\s*:\s*([^\n]+)"), "art_no": got(r"(?i)art\.?\s*no\.?\s*:?\s*([A-Z0-9\-]+)"), "manufacturer": got(r"(?i)manufacturer\s*:\s*([^\n]+)"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("path"), strip(v).alias("value")) for k, v in found.items()])
    return docs.select("doc_id", F.explode(pairs).alias("f")).select("doc_id", "f.*").where("value <> ''")


def line_items(tables: DataFrame) -> DataFrame:
    """doc_id, pos, description, amount: first and last cell of a Markdown table's rows that are items."""
    lines = tables.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where(F.col("line").startswith("|") & (F.regexp_replace("line", r"[|\-\s]", "") != ""))
    cols = F.transform(F.slice(F.split("line", r"\|"), 2, F.size(F.split("line", r"\|")) - 2), strip)
    cut = lines.withColumn("cols", cols).where(F.size("cols") >= 2).select("doc_id", "pos", F.get("cols", F.lit(0)).alias("a"), F.element_at("cols", -1).alias("b"))
    low = F.lower("a")
    kept = cut.where(~low.startswith("per ") & ~low.isin("--", "curr.", "tk20", "tk220") & ((F.col("a") != "") | (F.col("b") != "")))
    return kept.select("doc_id", "pos", F.nullif("a", F.lit("")).alias("description"), F.nullif("b", F.lit("")).alias("amount"))


def candidates(fields: DataFrame) -> DataFrame:
    """Leaves to verify: texts of three characters or more outside the bookkeeping fields."""
    last = F.element_at(F.split("path", r"\."), -1)
    return fields.where(~last.isin(*SKIPPED) & (F.length(strip(F.col("value"))) >= 3))


def verified(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """fields to verify, with `verbatim`: whether the source holds the value, both made comparable."""
    source = docs.select("doc_id", comparable(F.col("text")).alias("__source"))
    return candidates(fields).join(source, "doc_id", "left").withColumn("verbatim", F.coalesce(F.instr(F.col("__source"), comparable(F.col("value"))) > 0, F.lit(False))).drop("__source")


def fuzzy(needle: str, source: str, least: float = 0.85) -> tuple[float | None, str | None]:
    """Best similarity of a needle with the source's windows of about its length, and that window.

    A window's similarity is at most twice the letters it shares with the needle over both
    lengths. Those bounds are counted for all windows at once; only windows whose bound reaches
    `least` are compared, best bounds first. Without such a window there is none.
    """
    n, size = len(needle), len(source)
    if n < 3 or not size:
        return None, None
    codes = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {c: needle.count(c) for c in set(needle)}
    sums = {c: np.concatenate([[0], np.cumsum(codes == ord(c))]) for c in counts}
    windows: list[tuple[float, int, int]] = []
    for w in range(max(3, n - 3), min(n + 3, size) + 1):
        shared = np.zeros(size - w + 1, np.int64)
        for c, k in counts.items():
            shared += np.minimum(sums[c][w:] - sums[c][:-w], k)
        bound = 2 * shared / (n + w)
        windows += [(-float(bound[i]), int(i), w) for i in np.flatnonzero(bound >= least)]
    best, span = None, None
    match = difflib.SequenceMatcher(None, "", needle, autojunk=False)
    for bound, i, w in sorted(windows):
        if best is not None and -bound <= best:
            break
        match.set_seq1(source[i : i + w])
        if best is None or match.ratio() > best:
            best, span = match.ratio(), source[i : i + w]
    return best, span


def repaired(fields: DataFrame, docs: DataFrame, least: float = 0.85) -> DataFrame:
    """fields with ratio, repair and state: verified as they stand, repaired from a similar window, or flagged (with a null ratio where no window could reach `least`).

    Sources are made comparable once a document and joined once; only leaves that are not verbatim take
    theirs along to Python, in Arrow batches.
    """
    source = docs.select("doc_id", comparable(F.col("text")).alias("__source"))
    v = candidates(fields).join(source, "doc_id", "left").withColumn("__needle", comparable(F.col("value")))
    verbatim = F.coalesce(F.instr(F.col("__source"), F.col("__needle")) > 0, F.lit(False))
    v = v.withColumn("__source", F.when(~verbatim, F.coalesce("__source", F.lit(""))))  # null: verbatim
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields) + ", ratio double, repair string, state string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            exact = b["__source"].isna().tolist()
            got = [(1.0, n) if e else fuzzy(n, s, least) for e, n, s in zip(exact, b["__needle"], b["__source"], strict=True)]
            good = [r is not None and r >= least and s != n for (r, s), n in zip(got, b["__needle"], strict=True)]
            state = ["verified" if e else "repaired" if g else "flagged" for e, g in zip(exact, good, strict=True)]
            yield b.drop(columns=["__needle", "__source"]).assign(ratio=[None if r is None else round(r, 3) for r, _ in got], repair=[s if g else None for (_, s), g in zip(got, good, strict=True)], state=state)

    return v.mapInPandas(run, kinds)


def evidence(found: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, rank, snippet, page: the surest snippets of a document, each text once."""
    text = strip(F.col("value"))
    once = found.withColumn("__n", F.row_number().over(W.partitionBy("doc_id", F.lower(text)).orderBy(F.desc("ratio"), "k"))).where((F.col("__n") == 1) & (text != ""))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("ratio"), "k", "path"))).where(F.col("rank") <= most)
    return ranked.select("doc_id", "rank", F.substring(text, 1, 200).alias("snippet"), "page")


def page_references(found: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, pages: the sorted distinct pages of found values, at most `most`."""
    return found.where("page is not null").groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("page")), 1, most).alias("pages"))


def retry_candidates(fields: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, rank, path, reason: flagged values first, then empty ones taken in turn from each container."""
    paths = fields.groupBy("doc_id", "path").agg(F.max((F.col("state") == "flagged").cast("int")).alias("flagged"), F.max((~is_empty(F.col("value"))).cast("int")).alias("filled"))
    parent = F.when(F.instr("path", ".") > 0, F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("<root>")
    open_ = paths.where("flagged = 1 or filled = 0").withColumn("parent", parent)
    turn = F.row_number().over(W.partitionBy("doc_id", "flagged", "parent").orderBy("path"))
    ranked = open_.withColumn("turn", F.when(F.col("flagged") == 1, 0).otherwise(turn)).withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("flagged"), "turn", "parent", "path")))
    return ranked.where(F.col("rank") <= most).select("doc_id", "rank", "path", F.when(F.col("flagged") == 1, "flagged").otherwise("null_leaf").alias("reason"))


def page_before(source: Column, span: Column) -> Column:
    """The page of the last page mark before the first place of a span."""
    at = F.instr(F.lower(source), F.lower(span))
    marks = F.regexp_extract_all(F.left(source, at), F.lit(r"<!-- page:(\d+) -->"), F.lit(1))
    return F.when(at > 0, F.try_element_at(marks, F.lit(-1))).try_cast("int")


def at_path(record: Column, path: str) -> Column:
    """A value of a JSON text by a path such as a.b[0].c or a.0.c."""
    parts = path.replace("[", ".").replace("]", "").split(".")
    return F.get_json_object(record, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts))


def annotations(docs: DataFrame) -> DataFrame:
    """doc_id and what fixed patterns annotate: currency, standards, connectors, parameters."""
    t = F.col("text")
    standards = (r"\b(?:ISO|IEC|EN|DIN|ANSI|BS|CSA|UL)\s*[\-:]?\s*\d+[\-:]?\d*[\-:]?\d*", r"\bCE\s+(?:Mark|marked|certified)", r"\bRoHS", r"\bREACH", r"\bIP\d{2}")
    connectors = ("M12", "M8", "M5", "RJ45", "RJ11", "USB", "HDMI", "DIN", "XLR", "BNC", "DBE", "D-Sub", "Ethernet", "Serial", "Modular", "Circular", "Rectangular", "Inline")
    found = F.concat(*[F.regexp_extract_all(t, F.lit(ascii_rule(s)), F.lit(0)) for s in standards])
    used = F.filter(F.array(*[F.lit(c) for c in connectors]), lambda c: F.lower(t).contains(F.lower(c)))
    return docs.select("doc_id", F.regexp_extract(t, ascii_rule(r"\b(USD|EUR|GBP|CHF|JPY|CNY|INR|MXN)\b"), 1).alias("currency"), F.array_sort(F.array_distinct(found)).alias("standards"), F.array_sort(used).alias("connectors"))
