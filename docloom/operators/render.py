"""Markdown, manifests and summaries of ordered regions and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import strip

MANIFEST_TYPES = ("title", "heading", "text", "table", "figure", "caption", "footer", "header")


def decimal_text(c: Column, digits: int) -> Column:
    """A number with fixed digits, by way of a decimal, so that engines agree."""
    return c.cast(f"decimal(18,{digits})").cast("string")


def provenance() -> Column:
    """The comment that follows a region's Markdown."""
    box = F.concat_ws(",", *[decimal_text(F.col(s), 1) for s in ("x0", "y0", "x1", "y1")])
    return F.concat(F.lit("<!-- id:"), "region_id", F.lit(" page:"), F.col("page").cast("string"), F.lit(" type:"), "type", F.lit(" bbox:["), box, F.lit("] src:"), "source", F.lit(" conf:"), decimal_text(F.col("conf"), 2), F.lit(" -->"))


def line(kind: Column, text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    wrap = lambda a, b="": F.concat(F.lit("\n" + a), t, F.lit(b))
    figure = F.concat(F.lit("\n![Figure]()"), F.when(t != "", F.concat(F.lit("\n_"), t, F.lit("_"))).otherwise(""))
    return F.when(kind == "title", wrap("# ")).when(kind == "heading", wrap("## ")).when(kind == "figure", figure).when(kind == "caption", wrap("_", "_")).when(kind == "footer", wrap("<sub>", "</sub>")).otherwise(wrap(""))


def markdown(regions: DataFrame) -> DataFrame:
    """doc_id, markdown of regions with page, read_no, region_id: each region and its provenance, with page marks and rules between pages."""
    w = W.partitionBy("doc_id").orderBy("page", "read_no")
    before = F.lag("page").over(w)
    mark = F.when(before.isNull(), F.concat(F.lit("<!-- page:"), F.col("page").cast("string"), F.lit(" -->\n"))).when(before != F.col("page"), F.concat(F.lit("\n---\n\n<!-- page:"), F.col("page").cast("string"), F.lit(" -->\n"))).otherwise("")
    said = regions.withColumn("said", F.concat(mark, line(F.col("type"), F.col("text")), F.lit("\n"), provenance()))
    return said.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "read_no", "said"))), lambda r: r["said"]), "\n").alias("markdown"))


def manifest(regions: DataFrame) -> DataFrame:
    """doc_id, element_id, page, element_type, text_preview (120 characters), confidence, source."""
    kind = F.when(F.col("type").isin(*MANIFEST_TYPES), F.col("type")).otherwise("text")
    return regions.select("doc_id", F.col("region_id").alias("element_id"), "page", kind.alias("element_type"), F.substring(strip(F.coalesce("text", F.lit(""))), 1, 120).alias("text_preview"), F.col("conf").alias("confidence"), "source")


def page_markdown(regions: DataFrame, sizes: tuple[float, float] = (20, 16)) -> DataFrame:
    """doc_id, page, markdown: lines by type; text of large fonts (column size) as headings."""
    t = strip(F.coalesce("text", F.lit("")))
    level = F.when(F.col("type") == "title", "# ").when(F.col("size") > sizes[0], "# ").when(F.col("size") > sizes[1], "## ").when(F.col("type") == "heading", "### ")
    said = F.when(F.col("type") == "list", F.concat(F.lit("- "), F.regexp_replace(t, r"^[•\-*]\s*", ""))).when(F.col("type") == "caption", F.concat(F.lit("*"), t, F.lit("*"))).otherwise(F.concat(F.coalesce(level, F.lit("")), t))
    rows = regions.where(t != "").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("read_no", said.alias("s")))).alias("rows"))
    return rows.select("doc_id", "page", F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n").alias("markdown"))


def graph_summary(nodes: DataFrame) -> DataFrame:
    """doc_id, summary: each node's id, breadcrumb and first 200 characters, a line each."""
    said = F.concat(F.lit("["), "node_id", F.lit("] "), "breadcrumb", F.lit("\n"), F.substring("content", 1, 200))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_idx", said.alias("s")))), lambda r: r["s"]), "\n").alias("summary"))


def context(nodes: DataFrame) -> DataFrame:
    """doc_id, context: all nodes' contents in order."""
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_idx", "content"))), lambda r: r["content"]), "\n\n---\n\n").alias("context"))


def snapshots(regions: DataFrame) -> DataFrame:
    """doc_id, page, region_idx, file: names of a document's figure images in order, of others by id."""
    n = F.row_number().over(W.partitionBy("doc_id", F.col("type") == "figure").orderBy("page", "region_idx"))
    name = F.when(F.col("type") == "figure", F.format_string("figure_%03d.png", n)).otherwise(F.concat(F.lit("region_p"), F.col("page").cast("string"), F.lit("_r"), F.col("region_idx").cast("string"), F.lit(".png")))
    return regions.select("doc_id", "page", "region_idx", name.alias("file"))
