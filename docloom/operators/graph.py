"""The document graph: heading stacks, atomic chunks, nodes, links and batches.

The scans over a document's ordered regions are folds inside the JVM: one array per document, one
accumulator. What a fold finds (a region's stack and node number) is joined back by position, and
all else is grouped and windowed relationally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.functions.text import is_upper, strip
from docloom.operators.paged import carried, folded

ATOMIC = ("table", "figure", "caption", "footer")
MAX_CHUNK, OVERLAP, NEAR = 1200, 150, 80.0
REFERENCE = r"(?i)(?:Fig\.?|Figure|Table)\s*(\d+[A-Za-z]*)"
STATE = "struct<stack:array<string>,size:int,node:int,open:boolean>"


def next_stack(stack: Column, kind: Column, text: Column) -> Column:
    """The heading stack after a region."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.size(stack)
    first = F.get(stack, F.lit(0))
    deep = t.rlike(r"^\d+\.\d+\.\d+")
    top = (is_upper(t) & (F.length(t) > 3)) | (n == 0)
    heading = F.when(top, F.array(t)).when(deep & (n >= 2), F.array(first, F.get(stack, F.lit(1)), t)).when(deep, F.concat(stack, F.array(t))).when(n >= 2, F.array(first, t)).otherwise(F.concat(stack, F.array(t)))
    return F.when((t == "") | ~kind.isin("title", "heading"), stack).when(kind == "title", F.array(t)).otherwise(heading)


def chunked(regions: DataFrame, most: int = MAX_CHUNK) -> DataFrame:
    """regions with node_idx and stack: tables, figures, captions and footers alone; a title or heading begins a node; text fills one until it has over `most` characters."""
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("size"), F.lit(0).alias("node"), F.lit(False).alias("open"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        alone, head = r["type"].isin(*ATOMIC), r["type"].isin("title", "heading")
        size = F.length(F.coalesce(r["text"], F.lit("")))
        begins = (alone | head) & s["open"]  # what is open closes first
        node = s["node"] + F.when(begins, 1).otherwise(0)
        filled = F.when(begins | ~s["open"], size).otherwise(s["size"] + size)
        closes = alone | (~head & (filled > most))
        # a node shows the stack that holds when it closes
        stack = next_stack(s["stack"], r["type"], r["text"])
        after = F.struct(stack.alias("stack"), F.when(closes, 0).otherwise(filled).alias("size"), (node + F.when(closes, 1).otherwise(0)).alias("node"), (~closes).alias("open"))
        return after, F.struct(node.alias("node_idx"), stack.alias("stack"))

    return carried(regions, ["doc_id"], ["region_idx"], start, step, STATE, "struct<node_idx:int,stack:array<string>>")


def nodes(regions: DataFrame, most: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, node_idx, node_id, node_type, breadcrumb, page, content, contains_table, contains_figure, region_count, region_ids.

    A text node's content begins with the end of the text before it, where that is over `overlap`
    characters long.
    """
    c = chunked(regions, most)
    kind = F.col("type")
    text = F.coalesce("text", F.lit(""))
    shown = F.when(kind == "table", text).when(kind == "figure", F.concat(F.lit("[FIGURE: ]"), F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(""))).when(kind == "caption", F.concat(F.lit("Caption: "), text)).when(kind.isin("title", "heading"), F.concat(F.lit("## "), text)).otherwise(strip(text))
    plain = F.when(~kind.isin("table", "figure"), text)
    has = lambda t: F.max((kind == t).cast("int")) == 1
    row = F.struct("region_idx", shown.alias("s"), plain.alias("p"))
    made = c.groupBy("doc_id", "node_idx").agg(
        F.when(has("table"), "table").when(has("figure"), "figure").when(has("caption"), "caption").when(has("footer"), "footer").otherwise("text").alias("node_type"),
        F.max_by("stack", "region_idx").alias("hierarchy"), F.min_by("page", "region_idx").alias("page"), has("table").alias("contains_table"), has("figure").alias("contains_figure"),
        F.count("*").cast("int").alias("region_count"), F.sort_array(F.collect_list(row)).alias("rows"),
    )
    tail = strip(F.array_join(F.filter(F.transform("rows", lambda r: r["p"]), lambda p: p.isNotNull()), " "))
    made = made.withColumn("tail", F.when(F.length(tail) > overlap, F.substring(tail, -overlap, overlap)).otherwise(""))
    before = F.coalesce(F.lag("tail").over(W.partitionBy("doc_id").orderBy("node_idx")), F.lit(""))
    crumb = F.when(F.size("hierarchy") > 0, F.array_join("hierarchy", " > ")).otherwise("(Document Root)")
    made = made.withColumns({"breadcrumb": crumb, "before": before})
    lead = F.when(F.col("before") != "", F.concat(F.lit("... "), F.col("before"), F.lit(" (continued)\n\n"))).otherwise("")
    body = F.array_join(F.transform("rows", lambda r: r["s"]), "\n\n")
    content = strip(F.concat(F.lit("[CONTEXT: "), F.col("breadcrumb"), F.lit("]\n\n"), lead, body))
    return made.select(
        "doc_id", "node_idx", F.format_string("node_%03d", "node_idx").alias("node_id"), "node_type", "breadcrumb", "page", content.alias("content"),
        "contains_table", "contains_figure", "region_count", F.transform("rows", lambda r: r["region_idx"]).alias("region_ids"),
    )


def summary(made: DataFrame) -> DataFrame:
    """doc_id, nodes, chars and the deepest breadcrumb (longest, then first) of each document."""
    depth = F.size(F.split("breadcrumb", " > "))
    return made.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum(F.length("content")).alias("chars"), F.max_by("breadcrumb", F.struct(depth, -F.col("node_idx"))).alias("deepest"))


def caption_links(boxes: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, src, dst, edge_type, distance: each caption and its nearest table or figure on the page, nearer than `near`; both ways."""
    from docloom.operators.regions import pairs

    caps, visuals = boxes.where(F.col("type") == "caption"), boxes.where(F.col("type").isin("table", "figure"))
    d = pairs(caps, visuals).withColumn("distance", geo.gap("a_", "b_"))
    first = F.row_number().over(W.partitionBy("a_doc_id", "a_page", "a_region_idx").orderBy("distance", "b_region_idx"))
    best = d.withColumn("rank", first).where((F.col("rank") == 1) & (F.col("distance") < near))
    there = best.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("src"), F.col("b_region_idx").alias("dst"), F.lit("CAPTION_OF").alias("edge_type"), "distance")
    return there.unionByName(there.select("doc_id", "page", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("LINKED_TO").alias("edge_type"), "distance")).distinct()


def reference_links(made: DataFrame) -> DataFrame:
    """doc_id, src, dst: nodes that mention a figure's or table's number, and the last node of that number."""
    mentions = made.select("doc_id", "node_idx", "node_type", F.explode(F.regexp_extract_all("content", F.lit(REFERENCE), F.lit(1))).alias("ref")).withColumn("ref", F.lower("ref"))
    index = mentions.where(F.col("node_type").isin("figure", "table", "caption")).groupBy("doc_id", "ref").agg(F.max("node_idx").alias("dst"))
    return mentions.join(index, ["doc_id", "ref"]).where(F.col("dst") != F.col("node_idx")).select("doc_id", F.col("node_idx").alias("src"), "dst").distinct()


def edges(made: DataFrame) -> DataFrame:
    """doc_id, src, dst, edge_type: order of nodes, and references."""
    after = made.select("doc_id", F.lag("node_idx").over(W.partitionBy("doc_id").orderBy("node_idx")).alias("src"), F.col("node_idx").alias("dst")).where(F.col("src").isNotNull())
    return after.withColumn("edge_type", F.lit("CONTINUATION_OF")).unionByName(reference_links(made).withColumn("edge_type", F.lit("LINKED_TO")))


def neighbours(made: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that a node refers to, in order: doc_id, node_idx, neighbours."""
    return links.join(made.select("doc_id", F.col("node_idx").alias("dst"), "node_id"), ["doc_id", "dst"]).groupBy("doc_id", F.col("src").alias("node_idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", "node_id"))), lambda x: x["node_id"]), ",").alias("neighbours"))


def batches(pieces: DataFrame, most: int = 4000, order: str = "node_idx", size: Column | None = None) -> DataFrame:
    """pieces (doc_id, order, content) with batch_idx: filled in order up to `most` characters; a longer piece is a batch of its own."""
    n = F.length("content") if size is None else size
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("batch"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        huge = r["n"] > most
        turn = (s["size"] > 0) & (huge | (s["size"] + r["n"] > most))
        batch = s["batch"] + F.when(turn, 1).otherwise(0)
        after = F.struct(F.when(huge, 0).when(turn, r["n"]).otherwise(s["size"] + r["n"]).alias("size"), (batch + F.when(huge, 1).otherwise(0)).alias("batch"))
        return after, F.struct(batch.alias("batch_idx"))

    return carried(pieces.withColumn("n", n.cast("int")), ["doc_id"], [order], start, step, "struct<size:int,batch:int>", "struct<batch_idx:int>").drop("n")


def batched(made: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, batch_idx, batch_id, n_nodes, char_count, contains_table, contains_figure, text."""
    row = F.struct("node_idx", "content")
    return batches(made, most).groupBy("doc_id", "batch_idx").agg(
        F.format_string("batch_%04d", F.first("batch_idx") + 1).alias("batch_id"), F.count("*").alias("n_nodes"), F.sum(F.length("content")).alias("char_count"), F.bool_or("contains_table").alias("contains_table"),
        F.bool_or("contains_figure").alias("contains_figure"), F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["content"]), "\n\n").alias("text"),
    )


def shattered(made: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, node_idx, shard, chars, continued: nodes of over `most` characters cut between lines."""
    long = made.where(F.length("content") > most)
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shard"))

    def step(s: Column, line: Column) -> tuple[Column, Column]:
        n = F.length(line)
        turn = (s["size"] > 0) & (s["size"] + n > most)
        shard = s["shard"] + F.when(turn, 1).otherwise(0)
        return F.struct(F.when(turn, n + 1).otherwise(s["size"] + n + 1).alias("size"), shard.alias("shard")), F.struct(shard.alias("shard"), (n + 1).alias("n"))

    cut = folded(F.split("content", "\n"), start, step, "struct<size:int,shard:int>", "struct<shard:int,n:int>")
    parts = long.select("doc_id", "node_idx", F.explode(cut).alias("o")).groupBy("doc_id", "node_idx", "o.shard").agg(F.sum("o.n").alias("chars"))
    return parts.withColumn("continued", F.lead("shard").over(W.partitionBy("doc_id", "node_idx").orderBy("shard")).isNotNull())


def page_chunks(regions: DataFrame, most: int = 2500) -> DataFrame:
    """regions with chunk_idx and section_path: cut at titles and headings once over half full, and after text once full."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chunk"), F.array().cast("array<string>").alias("path"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        head = r["type"].isin("title", "heading")
        t = strip(F.coalesce(r["text"], F.lit("")))
        path = F.when(~head | (t == ""), s["path"]).when((r["type"] == "title") | (F.size(s["path"]) == 0), F.array(t)).otherwise(F.array(F.get(s["path"], F.lit(0)), t))
        cut = head & (s["size"] > most * 0.5)
        chunk = s["chunk"] + F.when(cut, 1).otherwise(0)
        size = F.when(cut, 0).otherwise(s["size"]) + F.length(F.coalesce(r["text"], F.lit("")))
        full = (size >= most) & ~r["type"].isin("table", "figure")
        after = F.struct(F.when(full, 0).otherwise(size).alias("size"), (chunk + F.when(full, 1).otherwise(0)).alias("chunk"), path.alias("path"))
        return after, F.struct(chunk.alias("chunk_idx"), F.array_join(path, " > ").alias("section_path"))

    return carried(regions, ["doc_id"], ["region_idx"], start, step, "struct<size:int,chunk:int,path:array<string>>", "struct<chunk_idx:int,section_path:string>")
