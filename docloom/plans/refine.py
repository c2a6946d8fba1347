"""Queries of the smaller steps, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import refine as op
from docloom.operators import tables as tb
from docloom.plans.regions import iou
from docloom.plans.tables import tabs
from docloom.sources.fixtures import load, oracle

Q: dict = {}
O: dict = {}  # noqa: E741
EMPTY = r"({0} is null or regexp_replace({0}, '^\s+|\s+$', '', 'g') = '')"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


@query("structure_cells", oracle("""
with p as (select doc_id * 2 + page as doc_id, case when region_idx % 3 = 0 then 'row' when region_idx % 3 = 1 then 'column' when region_idx = 2 then 'header' end as kind, x0, y0, x1, y1, conf as score from f_box),
r as (select *, row_number() over (partition by doc_id order by y0, x0, score) - 1 as row_no from p where kind = 'row'), c as (select *, row_number() over (partition by doc_id order by x0, y0, score) - 1 as col_no from p where kind = 'column'),
x as (select r.doc_id, row_no, col_no, greatest(r.x0, c.x0) as x0, greatest(r.y0, c.y0) as y0, least(r.x1, c.x1) as x1, least(r.y1, c.y1) as y1, least(r.score, c.score) as confidence from r join c on r.doc_id = c.doc_id)
select doc_id, row_no, col_no, x0, y0, x1, y1, confidence, row_no = 0 or exists (select 1 from p h where h.kind = 'header' and h.doc_id = x.doc_id and (x.x0 + x.x1) / 2 between h.x0 and h.x1 and (x.y0 + x.y1) / 2 between h.y0 and h.y1) as is_header from x where x1 > x0 and y1 > y0""", "box"))
def structure_cells(spark, sf):
    i = F.col("region_idx")
    kind = F.when(i % 3 == 0, "row").when(i % 3 == 1, "column").when(i == 2, "header")
    parts = load(spark, sf, "box").select((F.col("doc_id") * 2 + F.col("page")).alias("doc_id"), kind.alias("kind"), "x0", "y0", "x1", "y1", F.col("conf").alias("score"))
    return op.structure_cells(parts)


@query("row_structure_bonus", oracle("with r as (select doc_id, block_no, bool_or((x0 + x1) / 2 < 300) and bool_or((x0 + x1) / 2 > 300) as both from f_word group by all) select doc_id, round(case when count(*) < 2 then 0.0 else count_if(both) / count(*) end, 6) as bonus from r group by doc_id".replace("as both", "as sides").replace("count_if(both)", "count_if(sides)"), "word"))
def row_structure_bonus(spark, sf):
    w = load(spark, sf, "word").withColumnRenamed("block_no", "row_no")
    splits = w.select("doc_id").distinct().withColumn("split", F.lit(300.0))
    return op.row_structure(w, splits).withColumn("bonus", F.round("bonus", 6))


@query("text_figure_relation", oracle(f"""
with p as (select a.doc_id, a.page, a.region_idx, max(case when coalesce({iou('a.', 'b.')}, 0) > 0.7 then 2 when {iou('a.', 'b.')} > 0.1 and {iou('a.', 'b.')} < 0.7 and a.y0 > b.y1 then 1 else 0 end) as l from f_box a left join f_box b on a.doc_id = b.doc_id and a.page = b.page and b.type = 'figure' where a.type = 'text' group by all)
select doc_id, page, region_idx, case l when 2 then 'inside_figure' when 1 then 'caption' else 'separate' end as relation from p""", "box"))
def text_figure_relation(spark, sf):
    box = load(spark, sf, "box")
    return op.relationships(box.where("type = 'text'"), box.where("type = 'figure'"))


@query("line_expansion", oracle("""
with l as (select *, abs(y1 - y0) < 0.1 * abs(x1 - x0) as h from f_line where kind = 'line' and (abs(y1 - y0) < 0.1 * abs(x1 - x0) or abs(x1 - x0) < 0.1 * abs(y1 - y0)) and doc_id in (select doc_id from f_word)),
o as (select doc_id, h, case when h then y0 else x0 end as p, case when h then least(x0, x1) else least(y0, y1) end as a, case when h then greatest(x0, x1) else greatest(y0, y1) end as z, row_number() over (partition by doc_id order by line_idx) as k from l),
f as (select distinct doc_id, cast(0 as bigint) as k, 20.0 :: double as x0, 20.0 :: double as y0, 400.0 :: double as x1, 200.0 :: double as y1 from f_word
  union all select f.doc_id, o.k, case when h then n0 else m0 end, case when h then m0 else n0 end, case when h then n1 else m1 end, case when h then m1 else n1 end
  from f join o on o.doc_id = f.doc_id and o.k = f.k + 1,
  lateral (select case when h then f.x0 else f.y0 end as l0, case when h then f.x1 else f.y1 end as l1, case when h then f.y0 else f.x0 end as c0, case when h then f.y1 else f.x1 end as c1) v,
  lateral (select abs(p - c0) < 5 as first, abs(p - c1) < 5 as last) t,
  lateral (select case when (first or last) and a < l0 and z > l0 then a else l0 end as n0, case when (first or last) and z > l1 and a < l1 then z else l1 end as n1, case when first then least(c0, p) else c0 end as m0, case when last then greatest(c1, p) else c1 end as m1) n)
select doc_id, x0, y0, x1, y1 from f qualify row_number() over (partition by doc_id order by k desc) = 1""", "line", "word", recursive=True))
def line_expansion(spark, sf):
    t = load(spark, sf, "word").select("doc_id").distinct().withColumns({f"t_{s}": F.lit(v) for s, v in zip(("x0", "y0", "x1", "y1"), (20.0, 20.0, 400.0, 200.0), strict=True)})
    return op.expanded(load(spark, sf, "line"), t)


@query("qa_override_retry", oracle("""
with a as (select doc_id, case when condition % 2 = 0 then 'COMPLEX' else 'RULED' end as table_type, 0.9 + required_total * 0.03 as coverage, 0.04 + parse_failure_count * 0.02 as duplication, 0.8 :: double as row_sanity, parse_failure_count = 0 as passed, required_field_completion_rate as c2 from f_scorecard),
g as (select *, passed or (table_type = 'COMPLEX' and coverage >= 0.95 and duplication > 0.05 and duplication <= 0.08 and row_sanity >= 0.8) as good from a)
select doc_id, case when not good and c2 > coverage then 'kv_native_retry' else 'tsr' end as method, round(case when not good and c2 > coverage then c2 else coverage end, 6) as coverage, case when not good and c2 > coverage then true else good end as passed from g""", "scorecard"))
def qa_override_retry(spark, sf):
    s = load(spark, sf, "scorecard")
    first = s.select("doc_id", F.when(F.col("condition") % 2 == 0, "COMPLEX").otherwise("RULED").alias("table_type"), F.lit("tsr").alias("method"), (0.9 + F.col("required_total") * 0.03).alias("coverage"), (0.04 + F.col("parse_failure_count") * 0.02).alias("duplication"), F.lit(0.8).alias("row_sanity"), (F.col("parse_failure_count") == 0).alias("passed"))
    second = s.select("doc_id", F.lit("kv_native").alias("method"), F.col("required_field_completion_rate").alias("coverage"), F.lit(True).alias("passed"))
    return op.accepted(first, second).withColumn("coverage", F.round("coverage", 6))


@query("table_anchor_lines", oracle(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
f as (select doc_id, trim(regexp_replace(x, '^\s+|\s+$', '', 'g')) as x, row_number() over (partition by doc_id order by k) - 1 as i, count(*) over (partition by doc_id) as n from l where regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''),
d as (select *, abs((i + 0.5) * (200.0 / n) - 120) as d from f), b as (select doc_id, arg_min(i, (d, i)) as bi, min(d) as bd, any_value(n) as n from d group by doc_id),
a as (select d.doc_id, arg_min(x, d.i) as nxt from d join b using (doc_id) where d.i > bi and abs(d.d - bd) <= 100 and length(x) >= 3 and not starts_with(x, 'Pin') and d.n > 1 group by d.doc_id)
select b.doc_id, md5(x || case when nxt is null then '' else chr(10) || nxt end) as anchor from b join d on d.doc_id = b.doc_id and d.i = b.bi left join a on a.doc_id = b.doc_id"""))
def table_anchor_lines(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.md5(op.anchor_text(F.col("text"), F.lit(0.0), F.lit(200.0), F.lit(120.0))).alias("anchor")).where("anchor is not null")


_NAMES = "[['art_no', 'x'], ['unit_price', 'freight'], ['title'], ['patient', 'connectors', 'subtotal']][cast(o_orderkey % 4 as int) + 1]"
_DOMAINS = "['industrial', 'invoice', 'general', 'logistics', 'legal'][cast(o_custkey % 5 as int) + 1]"


@query("telltale_check", "select doc_id, array_to_string(list_sort(hits), ',') as hits from (select o_orderkey as doc_id, list_distinct(list_concat(" + ", ".join(f"case when {_DOMAINS} = '{d}' then [] else list_intersect({_NAMES}, [{', '.join(repr(n) for n in ns)}]) end" for d, ns in op.TELLTALES.items()) + f")) as hits from orders where o_custkey % 10 >= 5 and {_DOMAINS} <> 'general') x where len(hits) > 0")
def telltale_check(spark, sf):
    pick = lambda values, i: F.element_at(F.array(*values), (i + 1).cast("int"))
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    o = spark.read.parquet(f"{sf}/orders.parquet")
    s = o.select(F.col("o_orderkey").alias("doc_id"), pick([F.lit(d) for d in ("industrial", "invoice", "general", "logistics", "legal")], F.col("o_custkey") % 5).alias("domain"), ((F.col("o_custkey") % 10) / 10).alias("confidence"), pick([strings("art_no", "x"), strings("unit_price", "freight"), strings("title"), strings("patient", "connectors", "subtotal")], F.col("o_orderkey") % 4).alias("names"))
    return op.inconsistent(s).select("doc_id", F.array_join("hits", ",").alias("hits"))


@query("window_dedupe", oracle("""
with f as (select doc_id, region_idx * 37 as pos from f_line_text qualify row_number() over (partition by doc_id order by region_idx * 37) <= 3),
w as (select doc_id, pos, greatest(0, pos - 400) as start, least(5000, pos + 400) as stop from f)
select doc_id, start, stop from w qualify row_number() over (partition by doc_id, start // 100, stop // 100 order by pos) = 1""", "line_text"))
def window_dedupe(spark, sf):
    found = load(spark, sf, "line_text").select("doc_id", (F.col("region_idx") * 37).alias("pos"))
    return op.windows(found, F.lit(5000))


@query("currency_infill", oracle("select doc_id, case raw when '$ 5' then 'USD' else case when contains(raw, '$') then 'USD' when contains(raw, '€') then 'EUR' when contains(raw, '£') then 'GBP' when contains(raw, '¥') then 'JPY' when contains(raw, '₹') then 'INR' end end as currency from f_currency", "currency"))
def currency_infill(spark, sf):
    return load(spark, sf, "currency").select("doc_id", op.currency_of(F.lit(""), F.lit("none"), F.col("raw")).alias("currency"))


_RAW = "['mechnaical', 'Electrical', 'electricalxyz', 'other', 'enviromental', ' logistic '][cast(l_partkey % 6 as int) + 1]"


@query("param_types", "select raw, case " + " ".join(f"when lower(trim(raw)) = '{a}' then '{b}'" for a, b in op.SPELLINGS.items()) + " when lower(trim(raw)) in ('electrical', 'mechanical', 'environmental', 'logistical') then raw " + " ".join(f"when starts_with(lower(trim(raw)), '{t}') then '{t}'" for t in op.PARAM_TYPES) + f" else raw end as param_type, count(*) as n from (select {_RAW} as raw from lineitem) x group by 1, 2")
def param_types(spark, sf):
    raw = F.element_at(F.array(*[F.lit(v) for v in ("mechnaical", "Electrical", "electricalxyz", "other", "enviromental", " logistic ")]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(raw.alias("raw"))
    return rows.select("raw", op.param_type(F.col("raw")).alias("param_type")).groupBy("raw", "param_type").agg(F.count("*").alias("n"))


@query("param_units", oracle("select text, case when contains(text, 'V') then 'V' end as voltage_unit, case when contains(text, 'A') then 'A' when contains(text, 'mA') then 'mA' end as current_unit, count(*) as n from f_word group by 1, 2, 3", "word"))
def param_units(spark, sf):
    t = F.col("text")
    return load(spark, sf, "word").select("text", op.unit_for(F.lit("voltage"), t).alias("voltage_unit"), op.unit_for(F.lit("current"), t).alias("current_unit")).groupBy("text", "voltage_unit", "current_unit").agg(F.count("*").alias("n"))


@query("supplier_lines", oracle(r"""
with t as (select doc_id, 'head' || chr(10) || case doc_id % 3 when 0 then 'Supplier: ACME ' || doc_id when 1 then 'vendor:' || chr(10) || ' Next Ltd ' else 'nothing' end || chr(10) || 'from: Late Co' as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from t), n as (select *, trim(lead(line) over (partition by doc_id order by i)) as nx, trim(regexp_replace(line, '^[^:]*:', '')) as aft from l),
s as (select doc_id, i, case when length(aft) > 2 then aft when length(nx) > 2 then nx end as said from n where regexp_matches(lower(line), 'from:|supplier:|vendor:|manufacturer:|company:|seller:'))
select doc_id, arg_min(said, i) as found from s where said is not null group by doc_id""", "line"))
def supplier_lines(spark, sf):
    i = F.col("doc_id") % 3
    said = F.when(i == 0, F.concat(F.lit("Supplier: ACME "), "doc_id")).when(i == 1, F.lit("vendor:\n Next Ltd ")).otherwise("nothing")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("head\n"), said, F.lit("\nfrom: Late Co")).alias("text"))
    return op.named_after(d, op.SUPPLIER)


@query("document_titles", oracle("select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{w}') then '{t}'" for t, w in op.TITLES) + " else 'Technical Document' end as title from f_domain_text", "domain_text"))
def document_titles(spark, sf):
    return load(spark, sf, "domain_text").select("doc_id", op.title_of(F.col("text")).alias("title"))


@query("retry_prompts", oracle(rf"""
select doc_id, batch_idx, k, path, md5('Copy one value from the source, verbatim, on one line; null if it is not there.' || chr(10) || 'Field: ' || regexp_replace(split_part(path, '.', -1), '\[.*', '') || chr(10) || 'Within: ' || case when contains(path, '.') then regexp_replace(path, '\.[^.]*$', '') else '<root>' end || chr(10) || case when {EMPTY.format('value')} then 'No value was found before.' else 'The value ' || value || ' is suspect.' end || chr(10) || 'Source:' || chr(10) || 'page ' || page) as prompt from f_field""", "field"))
def retry_prompts(spark, sf):
    f = load(spark, sf, "field")
    return f.select("doc_id", "batch_idx", "k", "path", F.md5(op.retry_prompt(F.col("path"), F.col("value"), F.concat(F.lit("page "), "page"))).alias("prompt"))


@query("extraction_status", oracle("select doc_id, case when count(*) = 1 and sum(page * 500) < 4000 then 'direct' else 'batched' end as route, case when count_if(page % 3 = 0) > 0 then 'success' else 'failed' end as status, count_if(page % 3 = 0) as n_ok, count(*) as n_batches from f_field group by doc_id", "field"))
def extraction_status(spark, sf):
    return op.extraction_status(load(spark, sf, "field").select("doc_id", (F.col("page") * 500).alias("chars"), (F.col("page") % 3 == 0).alias("ok")))


@query("smoke_gate", oracle(f"select doc_id, bool_or(not {EMPTY.format('value')} and path <> 'page_references') as passed from f_field group by doc_id", "field"))
def smoke_gate(spark, sf):
    return op.smoke(load(spark, sf, "field"))


@query("first_pages_text", oracle("select doc_id, md5(string_agg(text, chr(10) order by region_idx)) as text from f_line_text where region_idx <= 10 group by doc_id", "line_text"))
def first_pages_text(spark, sf):
    t = load(spark, sf, "line_text").where("region_idx <= 10")
    return t.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("region_idx", "text"))), lambda r: r["text"]), "\n")).alias("text"))


@query("element_lookup", oracle("select doc_id, region_idx, type, text from f_box where page = 1 and contains(type, 'ti')", "box"))
def element_lookup(spark, sf):
    return load(spark, sf, "box").where((F.col("page") == 1) & F.col("type").contains("ti")).select("doc_id", "region_idx", "type", "text")


@query("keep_list", oracle("select b.doc_id, b.page, b.region_idx from f_box b semi join (select o_orderkey // 4 as doc_id, cast(o_custkey % 8 as int) as region_idx from orders) k on k.doc_id = b.doc_id and k.region_idx = b.region_idx", "box"))
def keep_list(spark, sf):
    keep = spark.read.parquet(f"{sf}/orders.parquet").select(F.floor(F.col("o_orderkey") / 4).alias("doc_id"), (F.col("o_custkey") % 8).cast("int").alias("region_idx"))
    return load(spark, sf, "box").join(keep, ["doc_id", "region_idx"], "left_semi").select("doc_id", "page", "region_idx")


@query("stylesheet_ground", oracle("""
with f as (select doc_id, font_size, fontname, count(*) as n, min(word_idx) as first, regexp_matches(lower(fontname), 'bold|black') as bold, cast(cast(font_size as decimal(6,1)) as varchar) || '/' || fontname as name from f_word group by doc_id, font_size, fontname)
select doc_id, name as body, '20.0/Planned' as title, 'planned-caption' as caption from f qualify row_number() over (partition by doc_id order by not bold desc, n desc, first) = 1""", "word"))
def stylesheet_ground(spark, sf):
    found = tb.stylesheet(load(spark, sf, "word"))
    planned = found.select("doc_id", F.lit("9.0/Planned").alias("p_body"), F.lit("20.0/Planned").alias("title"), F.lit("planned-caption").alias("caption"))
    return found.join(planned, "doc_id").select("doc_id", F.coalesce("body", "p_body").alias("body"), "title", "caption")


@query("table_words_used", oracle("select w.doc_id, count(*) as n from f_word w where (w.x0 + w.x1) / 2 between 0 and 600 and (w.y0 + w.y1) / 2 between 0 and 260 group by w.doc_id", "word"))
def table_words_used(spark, sf):
    from docloom.functions import geometry as geo

    return load(spark, sf, "word").join(tabs(spark, sf), "doc_id").where(geo.centre_in("", "t_")).groupBy("doc_id").agg(F.count("*").alias("n"))
