"""Queries over the document graph, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import graph as op
from docloom.sources.fixtures import load, oracle

Q: dict = {}
O: dict = {}  # noqa: E741
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


_T = STRIP.format("coalesce(r.text, '')")
_STACK = rf"""case when {_T} = '' or r.type not in ('title', 'heading') then f.stack when r.type = 'title' then [{_T}]
  when (upper({_T}) = {_T} and lower({_T}) <> {_T} and length({_T}) > 3) or len(f.stack) = 0 then [{_T}]
  when regexp_matches({_T}, '^\d+\.\d+\.\d+') and len(f.stack) >= 2 then [f.stack[1], f.stack[2], {_T}] when regexp_matches({_T}, '^\d+\.\d+\.\d+') then list_append(f.stack, {_T})
  when len(f.stack) >= 2 then [f.stack[1], {_T}] else list_append(f.stack, {_T}) end"""


def _fold(source: str) -> str:
    """A recursive walk over a document's regions: stack, node number, characters in the open node."""
    alone, head = "r.type in ('table', 'figure', 'caption', 'footer')", "r.type in ('title', 'heading')"
    begins = f"(({alone} or {head}) and f.open)"
    size = f"case when {begins} or not f.open then length(coalesce(r.text, '')) else f.size + length(coalesce(r.text, '')) end"
    closes = f"({alone} or (not {head} and {size} > 1200))"
    return f"""
with r as (select *, row_number() over (partition by doc_id order by region_idx) as k from {source}),
f as (select doc_id, cast(0 as bigint) as k, cast([] as varchar[]) as stack, cast(0 as bigint) as size, false as open, 0 as node, cast(null as int) as node_idx, cast(null as int) as region_idx from (select distinct doc_id from r)
  union all select r.doc_id, r.k, {_STACK}, case when {closes} then 0 else {size} end, not {closes}, f.node + (case when {begins} then 1 else 0 end) + (case when {closes} then 1 else 0 end), f.node + (case when {begins} then 1 else 0 end), r.region_idx
  from f join r on r.doc_id = f.doc_id and r.k = f.k + 1),
chunk as (select r.*, f.node_idx, f.stack from f join r on r.doc_id = f.doc_id and r.k = f.k)"""


_NODES = rf"""
made as (select doc_id, node_idx, case when bool_or(type = 'table') then 'table' when bool_or(type = 'figure') then 'figure' when bool_or(type = 'caption') then 'caption' when bool_or(type = 'footer') then 'footer' else 'text' end as node_type,
  arg_max(stack, region_idx) as hierarchy, bool_or(type = 'table') as contains_table, bool_or(type = 'figure') as contains_figure, cast(count(*) as int) as region_count,
  string_agg(case type when 'table' then coalesce(text, '') when 'figure' then '[FIGURE: ]' || case when coalesce(text, '') <> '' then chr(10) || text else '' end when 'caption' then 'Caption: ' || coalesce(text, '') when 'title' then '## ' || coalesce(text, '') when 'heading' then '## ' || coalesce(text, '') else {STRIP.format("coalesce(text, '')")} end, chr(10) || chr(10) order by region_idx) as body,
  {STRIP.format("coalesce(string_agg(case when type not in ('table', 'figure') then coalesce(text, '') end, ' ' order by region_idx), '')")} as tail from chunk group by doc_id, node_idx),
prev as (select *, coalesce(lag(case when length(tail) > 150 then right(tail, 150) else '' end) over (partition by doc_id order by node_idx), '') as before, case when len(hierarchy) > 0 then array_to_string(hierarchy, ' > ') else '(Document Root)' end as breadcrumb from made),
node as (select *, {STRIP.format("'[CONTEXT: ' || breadcrumb || ']' || chr(10) || chr(10) || case when before <> '' then '... ' || before || ' (continued)' || chr(10) || chr(10) else '' end || body")} as content from prev)"""


def _regions(spark, sf):
    """Lines of documents as regions on one page."""
    return load(spark, sf, "line_text").withColumn("page", F.lit(1))


@query("heading_stack", oracle(_fold("f_line_text") + " select doc_id, region_idx, array_to_string(stack, ' > ') as path, len(stack) as depth from chunk", "line_text", recursive=True))
def heading_stack(spark, sf):
    return op.chunked(_regions(spark, sf)).select("doc_id", "region_idx", F.array_join("stack", " > ").alias("path"), F.size("stack").cast("bigint").alias("depth"))


@query("atomic_chunks", oracle(_fold("f_html") + " select doc_id, region_idx, node_idx from chunk", "html", recursive=True))
def atomic_chunks(spark, sf):
    return op.chunked(load(spark, sf, "html")).select("doc_id", "region_idx", "node_idx")


@query("hkg_nodes", oracle(_fold("f_line_text") + "," + _NODES + " select doc_id, node_idx, node_type, breadcrumb, md5(content) as content, contains_table, contains_figure, region_count from node", "line_text", recursive=True))
def hkg_nodes(spark, sf):
    return op.nodes(_regions(spark, sf)).select("doc_id", "node_idx", "node_type", "breadcrumb", F.md5("content").alias("content"), "contains_table", "contains_figure", "region_count")


@query("hkg_summary", oracle(_fold("f_html") + "," + _NODES + " select doc_id, count(*) as n_nodes, sum(length(content)) as chars, arg_max(breadcrumb, (len(string_split(breadcrumb, ' > ')), -node_idx)) as deepest from node group by doc_id", "html", recursive=True))
def hkg_summary(spark, sf):
    return op.summary(op.nodes(load(spark, sf, "html")))


@query("overlap_tail", oracle(_fold("f_line_text") + "," + _NODES + " select doc_id, node_idx, length(before) as tail_chars from prev where before <> ''", "line_text", recursive=True))
def overlap_tail(spark, sf):
    head = F.regexp_extract("content", r"(?s)^\[CONTEXT: .*?\]\n\n\.\.\. (.*?) \(continued\)", 1)
    made = op.nodes(_regions(spark, sf)).where(F.col("content").contains(" (continued)\n\n"))
    return made.select("doc_id", "node_idx", F.length(head).alias("tail_chars")).where("tail_chars > 0")


_GAP = "sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2))"


@query("caption_links", oracle(f"""
with d as (select a.doc_id, a.page, a.region_idx as cap, b.region_idx as vis, {_GAP} as distance, row_number() over (partition by a.doc_id, a.page, a.region_idx order by {_GAP}, b.region_idx) as rn
  from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page where a.type = 'caption' and b.type in ('table', 'figure'))
select doc_id, page, cap as src, vis as dst, 'CAPTION_OF' as edge_type, round(distance, 6) as distance from d where rn = 1 and distance < 80
union select doc_id, page, vis, cap, 'LINKED_TO', round(distance, 6) from d where rn = 1 and distance < 80""", "box"))
def caption_links(spark, sf):
    return op.caption_links(load(spark, sf, "box")).withColumn("distance", F.round("distance", 6))


def _mentioning(spark, sf):
    return load(spark, sf, "box").select("doc_id", (F.col("page") * 100 + F.col("region_idx")).alias("node_idx"), F.when(F.col("type").isin("table", "figure", "caption"), F.col("type")).otherwise("text").alias("node_type"), F.col("text").alias("content"))


_MENTION = r"""
with m as (select doc_id, page * 100 + region_idx as node_idx, type, lower(unnest(regexp_extract_all(text, '(?i)(?:Fig\.?|Figure|Table)\s*(\d+[A-Za-z]*)', 1))) as ref from f_box),
i as (select doc_id, ref, max(node_idx) as dst from m where type in ('table', 'figure', 'caption') group by doc_id, ref)"""


@query("crossref_links", oracle(_MENTION + " select distinct m.doc_id, m.node_idx as src, i.dst from m join i using (doc_id, ref) where dst <> m.node_idx", "box"))
def crossref_links(spark, sf):
    return op.reference_links(_mentioning(spark, sf))


@query("graph_edges", oracle(_MENTION + ", n as (select doc_id, page * 100 + region_idx as node_idx from f_box) select doc_id, lag(node_idx) over (partition by doc_id order by node_idx) as src, node_idx as dst, 'CONTINUATION_OF' as edge_type from n qualify src is not null union all select distinct m.doc_id, m.node_idx, i.dst, 'LINKED_TO' from m join i using (doc_id, ref) where dst <> m.node_idx", "box"))
def graph_edges(spark, sf):
    return op.edges(_mentioning(spark, sf))


@query("graph_neighbors", oracle(_MENTION + ", e as (select distinct m.doc_id, m.node_idx as src, i.dst from m join i using (doc_id, ref) where dst <> m.node_idx) select doc_id, src as node_idx, string_agg('node_' || lpad(cast(dst as varchar), 3, '0'), ',' order by dst) as neighbours from e group by doc_id, src", "box"))
def graph_neighbors(spark, sf):
    made = _mentioning(spark, sf).withColumn("node_id", F.format_string("node_%03d", "node_idx"))
    return op.neighbours(made, op.reference_links(made))


@query("extraction_batches_atomic", oracle("""
with r as (select doc_id, region_idx, length(text) as n, type, row_number() over (partition by doc_id order by region_idx) as k from f_line_text),
f as (select doc_id, cast(0 as bigint) as k, cast(0 as bigint) as size, 0 as batch, cast(null as int) as batch_idx, cast(0 as bigint) as n, cast(null as varchar) as type from (select distinct doc_id from r)
  union all select r.doc_id, r.k, case when r.n > 2000 then 0 when f.size > 0 and f.size + r.n > 2000 then r.n else f.size + r.n end,
    f.batch + case when f.size > 0 and (r.n > 2000 or f.size + r.n > 2000) then 1 else 0 end + case when r.n > 2000 then 1 else 0 end,
    f.batch + case when f.size > 0 and (r.n > 2000 or f.size + r.n > 2000) then 1 else 0 end, r.n, r.type from f join r on r.doc_id = f.doc_id and r.k = f.k + 1)
select doc_id, batch_idx, count(*) as n_nodes, sum(n) as char_count, bool_or(type = 'table') as contains_table from f where k > 0 group by doc_id, batch_idx""", "line_text", recursive=True))
def extraction_batches_atomic(spark, sf):
    pieces = load(spark, sf, "line_text").select("doc_id", F.col("region_idx").alias("node_idx"), F.col("text").alias("content"), (F.col("type") == "table").alias("contains_table"), F.lit(False).alias("contains_figure"))
    return op.batched(pieces, 2000).select("doc_id", "batch_idx", "n_nodes", "char_count", "contains_table")


@query("extraction_batches_shatter", oracle("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where length(text) > 2000),
f as (select doc_id, cast(0 as bigint) as k, cast(0 as bigint) as size, 0 as shard, cast(0 as bigint) as n from (select distinct doc_id from l)
  union all select l.doc_id, l.k, case when f.size > 0 and f.size + length(line) > 2000 then length(line) + 1 else f.size + length(line) + 1 end, f.shard + case when f.size > 0 and f.size + length(line) > 2000 then 1 else 0 end, length(line) + 1
  from f join l on l.doc_id = f.doc_id and l.k = f.k + 1)
select doc_id, 0 as node_idx, shard, sum(n) as chars, shard < max(shard) over (partition by doc_id) as continued from f where k > 0 group by doc_id, shard""", "line", recursive=True))
def extraction_batches_shatter(spark, sf):
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit(0).alias("node_idx"), F.col("text").alias("content"))
    return op.shattered(whole, 2000)


@query("page_chunks", oracle(rf"""
with r as (select *, row_number() over (partition by doc_id order by region_idx) as k from f_line_text),
f as (select doc_id, cast(0 as bigint) as k, cast(0 as bigint) as size, 0 as chunk, cast([] as varchar[]) as path, cast(null as int) as chunk_idx, cast(null as int) as region_idx from (select distinct doc_id from r)
  union all select r.doc_id, r.k, case when s.size >= 2500 and r.type not in ('table', 'figure') then 0 else s.size end, f.chunk + s.cut + case when s.size >= 2500 and r.type not in ('table', 'figure') then 1 else 0 end,
    case when r.type not in ('title', 'heading') or {_T} = '' then f.path when r.type = 'title' or len(f.path) = 0 then [{_T}] else [f.path[1], {_T}] end, f.chunk + s.cut, r.region_idx
  from f join r on r.doc_id = f.doc_id and r.k = f.k + 1,
  lateral (select case when r.type in ('title', 'heading') and f.size > 1250 then 1 else 0 end as cut, case when r.type in ('title', 'heading') and f.size > 1250 then 0 else f.size end + length(coalesce(r.text, '')) as size) s)
select doc_id, region_idx, chunk_idx, array_to_string(path, ' > ') as section_path from f where k > 0""", "line_text", recursive=True))
def page_chunks(spark, sf):
    return op.page_chunks(load(spark, sf, "line_text")).select("doc_id", "region_idx", "chunk_idx", "section_path")
