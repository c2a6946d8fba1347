"""Queries of routing, records, evaluation, rendering and profiles, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import evaluation as ev
from docloom.operators import profile, regions, render, routing
from docloom.operators import records as op
from docloom.operators import tables as tb
from docloom.sources.fixtures import load, oracle

Q: dict = {}
O: dict = {}  # noqa: E741
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
EMPTY = r"({0} is null or regexp_replace({0}, '^\s+|\s+$', '', 'g') = '')"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- routing


def _score(patterns) -> str:
    return " + ".join(f"cast(regexp_matches(lower(text), '{p}') as int)" for p in patterns)


def _domain(buckets: dict, digits: int) -> str:
    names = [f"s{i}" for i in range(len(buckets))]
    cols = ", ".join(f"{_score(p)} as s{i}" for i, p in enumerate(buckets.values()))
    total, best = " + ".join(names), f"greatest({', '.join(names)})"
    picks = " ".join(f"when s{i} = {best} then '{k}'" for i, k in enumerate(buckets))
    return f"with s as (select doc_id, {cols} from f_domain_text) select doc_id, case when {total} = 0 then 'General' {picks} end as domain, case when {total} = 0 then 0.0 else round({best} / ({total}), {digits}) end as confidence from s"


@query("domain_route", oracle(_domain(routing.AUDIT, 4), "domain_text"))
def domain_route(spark, sf):
    return routing.domain(load(spark, sf, "domain_text"), routing.AUDIT, 4)


@query("domain_scout", oracle(_domain(routing.SCOUT, 2), "domain_text"))
def domain_scout(spark, sf):
    return routing.domain(load(spark, sf, "domain_text"), routing.SCOUT, 2)


@query("industrial_subtype", oracle(f"with s as (select doc_id, {_score(routing.SUBTYPES['manual'])} as m, {_score(routing.SUBTYPES['product'])} as p, {_score(routing.SUBTYPES['datasheet'])} as d from f_domain_text) select doc_id, case when p >= greatest(d, m) and p >= 2 then 'product_pdf' when m > d then 'technical_manual' else 'technical_datasheet' end as subtype from s", "domain_text"))
def industrial_subtype(spark, sf):
    return routing.industrial_subtype(load(spark, sf, "domain_text"))


@query("schema_cues", oracle("select doc_id, " + ", ".join(f"regexp_matches(lower(text), '{'|'.join(p)}') as {k}" for k, p in routing.CUES.items()) + " from f_domain_text", "domain_text"))
def schema_cues(spark, sf):
    return routing.schema_cues(load(spark, sf, "domain_text"))


@query("audit_route", oracle(
    _domain(routing.AUDIT, 4).replace("with s as", "with s as", 1).replace("select doc_id, case when s0", ", a as (select doc_id, case when s0", 1) + f"), t as (select doc_id, {_score(routing.SUBTYPES['manual'])} as m, {_score(routing.SUBTYPES['product'])} as p, {_score(routing.SUBTYPES['datasheet'])} as d from f_domain_text), "
    "e as (select a.doc_id, confidence, confidence >= 0.75 as sure, case when confidence >= 0.75 and domain <> 'Industrial' then domain when p >= greatest(d, m) and p >= 2 then 'Industrial_product_pdf' when m > d then 'Industrial_manual' else 'Industrial_datasheet' end as domain from a join t using (doc_id)) "
    "select doc_id, domain, case domain " + " ".join(f"when '{k}' then '{v}'" for k, v in routing.FAMILIES.items()) + " else 'general_v1' end as family, confidence, case when sure then 'heuristic' else 'fallback' end as source from e", "domain_text"))  # fmt: skip
def audit_route(spark, sf):
    return routing.audited(load(spark, sf, "domain_text"))


@query("schema_registry", "select * from (values " + ", ".join(f"('{d}', '{f}', '{', '.join(routing.MODULES.get(d, ()))}')" for d, f in routing.FAMILIES.items()) + ") t(domain, family, modules)")
def schema_registry(spark, sf):
    return routing.registry(spark)


# --- records


@query("additive_merge", oracle(f"select doc_id, path, arg_min(value, (batch_idx, k, value)) as value from f_field where not {EMPTY.format('value')} group by doc_id, path", "field"))
def additive_merge(spark, sf):
    return op.merged(load(spark, sf, "field"))


@query("list_merge", oracle("""
with v as (select *, row_number() over (partition by doc_id, path, value order by batch_idx, k) as n from f_field where value is not null)
select doc_id, path, string_agg(value, '~' order by batch_idx, k, value) as items from v where n = 1 or path not in ('page_references', 'standards', 'key_points') group by doc_id, path""", "field"))
def list_merge(spark, sf):
    return op.merged_lists(load(spark, sf, "field")).select("doc_id", "path", F.array_join("items", "~").alias("items"))


@query("param_dedupe", oracle(f"select doc_id, path, batch_idx, k, value from f_field qualify row_number() over (partition by doc_id, value order by batch_idx, k, path) = 1 or {EMPTY.format('value')}", "field"))
def param_dedupe(spark, sf):
    return op.first_by_name(load(spark, sf, "field"), "value", ["batch_idx", "k", "path"]).select("doc_id", "path", "batch_idx", "k", "value")


@query("line_dedupe", oracle(rf"with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) select doc_id, cast(pos as int) as pos, length(line) as n from l where {STRIP.format('line')} <> '' qualify row_number() over (partition by doc_id, {STRIP.format('line')} order by pos) = 1"))
def line_dedupe(spark, sf):
    return op.first_lines(docs(spark, sf)).select("doc_id", "pos", F.length("line").cast("bigint").alias("n"))


_TARGETS = {"vendor.name": "unknown", "total_price": "0", "currency": "EUR"}


@query("project_schema", oracle(f"""
with r as (select doc_id, path, arg_min(value, (batch_idx, k, value)) as value from f_field where not {EMPTY.format('value')} group by doc_id, path),
d as (select distinct doc_id from r union select doc_id from f_truth)
select d.doc_id, coalesce(a.value, x.expected, 'unknown') as vendor_name, coalesce(b.value, y.expected, '0') as total_price, coalesce(c.value, 'EUR') as currency from d
left join r a on a.doc_id = d.doc_id and a.path = 'vendor.name' left join r b on b.doc_id = d.doc_id and b.path = 'total_price' left join r c on c.doc_id = d.doc_id and c.path = 'currency'
left join f_truth x on x.doc_id = d.doc_id and x.path = 'vendor.name' left join f_truth y on y.doc_id = d.doc_id and y.path = 'total_price'""", "field", "truth"))
def project_schema(spark, sf):
    inferred = load(spark, sf, "truth").withColumnRenamed("expected", "value")
    return op.projected(op.merged(load(spark, sf, "field")), inferred, _TARGETS)


@query("regex_fields", oracle(r"""
with t as (select doc_id, text || ' Invoice No: AB-' || doc_id || '7 total USD 5' as text from f_domain_text)
select doc_id, regexp_extract(text, '(?i)invoice\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*\d)', 1) as invoice_number, regexp_extract(text, '\b(USD|EUR|GBP|INR|JPY|CNY|MXN|BRL|AUD|CAD|CHF|SGD)\b', 1) as currency from t""", "domain_text"))
def regex_fields(spark, sf):
    t = load(spark, sf, "domain_text").withColumn("text", F.concat("text", F.lit(" Invoice No: AB-"), "doc_id", F.lit("7 total USD 5")))
    return op.inferred(t).where("path in ('invoice_number', 'currency')").groupBy("doc_id").pivot("path", ["invoice_number", "currency"]).agg(F.first("value"))


@query("line_items", oracle(r"""
with l as (select doc_id, region_idx, text as line, string_split(text, '|') as c from f_line_text where type = 'table'),
x as (select doc_id, region_idx, trim(c[2]) as a, trim(c[-2]) as b, len(c) - 2 as n from (select doc_id, region_idx, string_split('| ' || line || ' |', '|') as c from l))
select doc_id, region_idx, nullif(a, '') as description, nullif(b, '') as amount from x where n >= 2 and not starts_with(lower(a), 'per ') and lower(a) not in ('--', 'curr.', 'tk20', 'tk220') and (a <> '' or b <> '')""", "line_text"))
def line_items(spark, sf):
    t = load(spark, sf, "line_text").where("type = 'table'").select((F.col("doc_id") * 1000 + F.col("region_idx")).alias("doc_id"), F.concat(F.lit("| "), "text", F.lit(" |")).alias("markdown"))
    items = op.line_items(t)
    return items.select(F.floor(F.col("doc_id") / 1000).alias("doc_id"), (F.col("doc_id") % 1000).cast("int").alias("region_idx"), "description", "amount")


def _said(spark, sf):
    """Fields whose values are pieces of their document's text, changed for every third."""
    d = docs(spark, sf).select("doc_id", "text")
    k = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    piece = F.substring(F.col("text").substr(F.col("k") * 37 + 1, F.lit(24)), 1, 24)
    value = F.when((F.col("doc_id") + F.col("k")) % 3 == 0, F.concat(piece, F.lit(" qqq"))).otherwise(F.replace(piece, F.lit(" "), F.lit("  ")))
    return d.withColumn("k", k).select("doc_id", "k", F.concat(F.lit("f"), "k").alias("path"), value.alias("value"), (F.col("k") + 1).alias("page"))


_PIECES = r"""
p as (select doc_id, k, 'f' || k as path, case when (doc_id + k) % 3 = 0 then substr(text, k * 37 + 1, 24) || ' qqq' else replace(substr(text, k * 37 + 1, 24), ' ', '  ') end as value, text from documents, (select unnest(range(0, 4)) as k) x),
c as (select doc_id, k, path, value, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) as nv, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as ns from p where length(regexp_replace(value, '^\s+|\s+$', '', 'g')) >= 3),
v as (select doc_id, k, path, value, contains(ns, nv) as verbatim from c)"""


@query("span_verify_exact", f"with {_PIECES} select doc_id, path, verbatim from v")
def span_verify_exact(spark, sf):
    return op.verified(_said(spark, sf), docs(spark, sf)).select("doc_id", "path", "verbatim")


@query("span_verify_fuzzy")
def span_verify_fuzzy(spark, sf):
    short = docs(spark, sf).select("doc_id", F.col("text"))
    return op.repaired(_said(spark, sf), short).select("doc_id", "path", "state", "ratio", "repair")


@query("provenance_fill", f"with {_PIECES}, e as (select doc_id, k, path, value, regexp_replace(value, '^\\s+|\\s+$', '', 'g') as t, case when verbatim then 1.0 else 0.9 end as ratio, k + 1 as page from v), o as (select * from e qualify row_number() over (partition by doc_id, lower(t) order by ratio desc, k) = 1 and t <> ''), r as (select *, row_number() over (partition by doc_id order by ratio desc, k, path) as rank from o) select doc_id, cast(rank as int) as rank, substr(t, 1, 200) as snippet, cast(page as int) as page from r where rank <= 6")
def provenance_fill(spark, sf):
    v = op.verified(_said(spark, sf), docs(spark, sf)).withColumn("ratio", F.when(F.col("verbatim"), 1.0).otherwise(0.9))
    return op.evidence(v)


@query("page_references", oracle("select doc_id, array_to_string(list_sort(list_distinct(list(page)))[:10], ',') as pages from f_field where page is not null group by doc_id", "field"))
def page_references(spark, sf):
    return op.page_references(load(spark, sf, "field")).select("doc_id", F.array_join("pages", ",").alias("pages"))


@query("retry_candidates", oracle(f"""
with p as (select doc_id, path, max(case when k % 10 = 0 then 1 else 0 end) as flagged, max(case when {EMPTY.format('value')} then 0 else 1 end) as filled from f_field group by doc_id, path),
o as (select *, case when contains(path, '.') then regexp_replace(path, '\\.[^.]*$', '') else '<root>' end as parent from p where flagged = 1 or filled = 0),
t as (select *, case when flagged = 1 then 0 else row_number() over (partition by doc_id, flagged, parent order by path) end as turn from o),
r as (select *, row_number() over (partition by doc_id order by flagged desc, turn, parent, path) as rank from t)
select doc_id, cast(rank as int) as rank, path, case when flagged = 1 then 'flagged' else 'null_leaf' end as reason from r where rank <= 5""", "field"))
def retry_candidates(spark, sf):
    f = load(spark, sf, "field").withColumn("state", F.when(F.col("k") % 10 == 0, "flagged").otherwise("verified"))
    return op.retry_candidates(f)


@query("page_lookup", oracle("select doc_id, region_idx % 5 + 1 as page, region_idx from f_line_text where length(text) > 30", "line_text"))
def page_lookup(spark, sf):
    t = load(spark, sf, "line_text").where("length(text) > 30")
    source = F.concat(F.lit("<!-- page:9 -->\nx\n<!-- page:"), (F.col("region_idx") % 5 + 1).cast("string"), F.lit(" -->\n"), F.col("text"), F.lit("\n<!-- page:77 -->"))
    return t.select("doc_id", op.page_before(source, F.upper(F.substring("text", 5, 20))).alias("page"), "region_idx")


@query("path_lookup", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def path_lookup(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", op.at_path(F.col("props"), "k").cast("int").alias("k"))


@query("annotations", oracle(r"""
with t as (select doc_id, text || case when doc_id % 3 = 0 then ' ISO 9001 and IP67 RoHS USD M12 usb' when doc_id % 3 = 1 then ' EN 60529-1 rj45' else '' end as t from f_domain_text)
select doc_id, regexp_extract(t, '(?i)\b(USD|EUR|GBP|CHF|JPY|CNY|INR|MXN)\b', 1) as currency, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '(?i)\b(?:ISO|IEC|EN|DIN|ANSI|BS|CSA|UL)\s*[\-:]?\s*\d+[\-:]?\d*[\-:]?\d*'), regexp_extract_all(t, '(?i)\bCE\s+(?:Mark|marked|certified)'), regexp_extract_all(t, '(?i)\bRoHS'), regexp_extract_all(t, '(?i)\bREACH'), regexp_extract_all(t, '(?i)\bIP\d{2}')))), ',') as standards,
  array_to_string(list_sort(list_filter(['M12','M8','M5','RJ45','RJ11','USB','HDMI','DIN','XLR','BNC','DBE','D-Sub','Ethernet','Serial','Modular','Circular','Rectangular','Inline'], lambda c: contains(lower(t), lower(c)))), ',') as connectors from t""", "domain_text"))
def annotations(spark, sf):
    i = F.col("doc_id") % 3
    t = load(spark, sf, "domain_text").withColumn("text", F.concat("text", F.when(i == 0, " ISO 9001 and IP67 RoHS USD M12 usb").when(i == 1, " EN 60529-1 rj45").otherwise("")))
    return op.annotations(t).select("doc_id", "currency", F.array_join("standards", ",").alias("standards"), F.array_join("connectors", ",").alias("connectors"))


# --- evaluation

_REQUIRED = ["vendor.name", "total_price", "currency"]


@query("required_completion", oracle(f"""
with r as (select doc_id, path, arg_min(value, (batch_idx, k, value)) as value from f_field where not {EMPTY.format('value')} group by doc_id, path)
select doc_id, array_to_string(list_sort(list_filter(['vendor.name', 'total_price', 'currency'], lambda x: not list_contains(list(path), x))), ',') as required_missing, round(count_if(path in ('vendor.name', 'total_price', 'currency')) / 3, 4) as rate from r group by doc_id""", "field"))
def required_completion(spark, sf):
    return ev.completion(op.merged(load(spark, sf, "field")), _REQUIRED).withColumn("required_missing", F.array_join("required_missing", ","))


@query("gt_match", oracle(f"""
with r as (select doc_id, path, arg_min(value, (batch_idx, k, value)) as value from f_field where not {EMPTY.format('value')} group by doc_id, path),
t as (select t.doc_id, t.path, value is not null and (contains(lower(trim(value)), lower(trim(expected))) or contains(lower(trim(expected)), lower(trim(value)))) as hit from f_truth t left join r using (doc_id, path)),
p as (select doc_id, count(*) as n, count_if(hit) as hits, coalesce(string_agg(path, ',' order by path) filter (hit), '') as matched from t group by doc_id), f as (select doc_id, count(distinct split_part(path, '.', 1)) as filled from r group by doc_id),
m as (select p.doc_id, matched, case when filled > 0 then hits / filled else 0.0 end as pr, hits / n as rc from p left join f using (doc_id))
select doc_id, round(pr, 4) as precision, round(rc, 4) as recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end, 4) as f1, matched from m""", "field", "truth"))
def gt_match(spark, sf):
    m = ev.truth_metrics(op.merged(load(spark, sf, "field")), load(spark, sf, "truth"))
    return m.select("doc_id", "precision", "recall", "f1", F.array_join("matched", ",").alias("matched"))


@query("scorecard", oracle(f"""
with r as (select doc_id, path, value from f_field), e as (select doc_id, path, max(case when {EMPTY.format('value')} then 0 else 1 end) as filled from r group by doc_id, path)
select doc_id, case when count_if(filled = 1 and path in ('vendor.name', 'total_price', 'currency')) = 3 then 1.0 else 0.0 end as schema_validity_rate, round(count_if(filled = 1 and path in ('vendor.name', 'total_price', 'currency')) / 3, 4) as required_field_completion_rate,
  max(case when filled = 1 and path <> 'page_references' then 1.0 else 0.0 end) as non_empty_extraction_rate, max(case when filled = 1 and path = 'page_references' then 1.0 else 0.0 end) as grounded_reference_rate, 3 as required_total, 3 - count_if(filled = 1 and path in ('vendor.name', 'total_price', 'currency')) as required_missing_count from e group by doc_id""", "field"))
def scorecard(spark, sf):
    return ev.scorecards(load(spark, sf, "field"), _REQUIRED)


_CLASSES = "case when status = 'pipeline_error' then ['F5'] else list_filter([case when parse_failure_count > 0 then 'F1' end, case when required_missing_count > 0 and required_missing_count = required_total then 'F4' end, case when required_missing_count > 0 and required_missing_count <> required_total then 'F3' end, case when schema_validity_rate = 0 and required_missing_count = 0 then 'F2' end], lambda x: x is not null) end"


@query("failure_classes", oracle(f"select doc_id, array_to_string({_CLASSES}, ',') as codes from f_scorecard", "scorecard"))
def failure_classes(spark, sf):
    return load(spark, sf, "scorecard").select("doc_id", F.array_join(ev.failure_classes(), ",").alias("codes"))


@query("failure_breakdown", oracle(f"with c as (select unnest({_CLASSES}) as code from f_scorecard) select k.code, k.label, count(c.code) as n from (values " + ", ".join(f"('{a}', '{b}')" for a, b in ev.FAILURES.items()) + ") k(code, label) left join c using (code) group by k.code, k.label", "scorecard"))
def failure_breakdown(spark, sf):
    return ev.failures(load(spark, sf, "scorecard"))


@query("corpus_report", oracle(" union all ".join(f"select '{m}' as metric, round(avg({m}), 4) as mean, round(coalesce(stddev_samp({m}), 0), 4) as std, round(min({m}), 4) as min, round(max({m}), 4) as max, count({m}) as n from f_scorecard" for m in ev.METRICS), "scorecard"))
def corpus_report(spark, sf):
    return ev.report(load(spark, sf, "scorecard"))


@query("corpus_success", oracle("select count(*) as n_docs, count_if(status = 'success') as n_success, count_if(status <> 'success') as n_failure, round(count_if(status = 'success') / count(*), 4) as success_rate from f_scorecard", "scorecard"))
def corpus_success(spark, sf):
    return ev.success(load(spark, sf, "scorecard"))


@query("ablation_table", oracle(" union all ".join(f"select '{m}' as metric, " + ", ".join(f"round(avg({m}) filter (condition = {i}), 4) as A{i}" for i in range(4)) + " from f_scorecard" for m in ev.METRICS), "scorecard"))
def ablation_table(spark, sf):
    return ev.ablation(load(spark, sf, "scorecard"))


@query("retention", oracle(" union all ".join(f"select '{m}' as metric, round(avg({m}) filter (condition = 0), 4) as teacher, round(avg({m}) filter (condition = 1), 4) as specialist, round(least(avg({m}) filter (condition = 1) / nullif(avg({m}) filter (condition = 0), 0), 1), 4) as retention from f_scorecard" for m in ev.METRICS), "scorecard"))
def retention(spark, sf):
    s = load(spark, sf, "scorecard")
    return ev.retention(s.where("condition = 1"), s.where("condition = 0"))


@query("field_coverage", oracle("select path, count(distinct doc_id) as n, round(count(distinct doc_id) / (select count(distinct doc_id) from f_truth), 4) as share from f_truth group by path", "truth"))
def field_coverage(spark, sf):
    return ev.coverage(load(spark, sf, "truth"))


@query("gt_enrich", oracle("select s.doc_id, case when t.f1 is null then s.gt_field_f1 when s.status = 'failed' then 0.0 else t.f1 end as gt_field_f1 from f_scorecard s left join (select doc_id, count(*) / 10 as f1 from f_truth group by doc_id) t on t.doc_id = s.doc_id", "scorecard", "truth"))
def gt_enrich(spark, sf):
    m = load(spark, sf, "truth").groupBy("doc_id").agg((F.count("*") / 10).alias("f1"))
    return ev.enriched(load(spark, sf, "scorecard"), m).select("doc_id", "gt_field_f1")


# --- rendering

_ORDERED = "o as (select *, row_number() over (partition by doc_id, page order by y0, case when x1 - x0 > 612 * 0.6 then 2 when (x0 + x1) / 2 < 306 then 0 else 1 end, region_idx) - 1 as read_no from f_box), r as (select *, 'p' || page || '_r' || read_no as region_id from o)"


@query("markdown_render", oracle(rf"""
with {_ORDERED}, m as (select *, lag(page) over (partition by doc_id order by page, read_no) as prev,
  case type when 'title' then chr(10) || '# ' || trim(text) when 'heading' then chr(10) || '## ' || trim(text) when 'figure' then chr(10) || '![Figure]()' || chr(10) || '_' || trim(text) || '_' when 'caption' then chr(10) || '_' || trim(text) || '_' when 'footer' then chr(10) || '<sub>' || trim(text) || '</sub>' else chr(10) || trim(text) end as body,
  '<!-- id:' || region_id || ' page:' || page || ' type:' || type || ' bbox:[' || cast(x0 as decimal(18,1)) || ',' || cast(y0 as decimal(18,1)) || ',' || cast(x1 as decimal(18,1)) || ',' || cast(y1 as decimal(18,1)) || '] src:' || source || ' conf:' || cast(conf as decimal(18,2)) || ' -->' as prov from r)
select doc_id, md5(string_agg(case when prev is null then '<!-- page:' || page || ' -->' || chr(10) when prev <> page then chr(10) || '---' || chr(10) || chr(10) || '<!-- page:' || page || ' -->' || chr(10) else '' end || body || chr(10) || prov, chr(10) order by page, read_no)) as markdown from m group by doc_id""", "box"))
def markdown_render(spark, sf):
    return render.markdown(regions.reading_order(load(spark, sf, "box"))).select("doc_id", F.md5("markdown").alias("markdown"))


@query("manifest", oracle(f"with {_ORDERED} select doc_id, region_id as element_id, page, case when type in ('title','heading','text','table','figure','caption','footer','header') then type else 'text' end as element_type, substr(trim(text), 1, 120) as text_preview, conf as confidence, source from r", "box"))
def manifest(spark, sf):
    return render.manifest(regions.reading_order(load(spark, sf, "box")))


@query("page_markdown", oracle(rf"""
with {_ORDERED} select doc_id, page, md5(string_agg(case when type = 'list' then '- ' || regexp_replace(trim(text), '^[•\-*]\s*', '') when type = 'caption' then '*' || trim(text) || '*' else case when type = 'title' then '# ' when 8 + region_idx % 15 > 20 then '# ' when 8 + region_idx % 15 > 16 then '## ' when type = 'heading' then '### ' else '' end || trim(text) end, chr(10) || chr(10) order by read_no)) as markdown from r group by doc_id, page""", "box"))
def page_markdown(spark, sf):
    r = regions.reading_order(load(spark, sf, "box")).withColumn("size", 8 + F.col("region_idx") % 15)
    return render.page_markdown(r).withColumn("markdown", F.md5("markdown"))


@query("graph_summary_text", oracle("select doc_id, md5(string_agg('[' || 'node_' || lpad(cast(page * 100 + region_idx as varchar), 3, '0') || '] ' || type || chr(10) || substr(text, 1, 200), chr(10) order by page * 100 + region_idx)) as summary, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page * 100 + region_idx)) as context from f_box group by doc_id", "box"))
def graph_summary_text(spark, sf):
    n = load(spark, sf, "box").select("doc_id", (F.col("page") * 100 + F.col("region_idx")).alias("node_idx"), F.col("type").alias("breadcrumb"), F.col("text").alias("content")).withColumn("node_id", F.format_string("node_%03d", "node_idx"))
    return render.graph_summary(n).join(render.context(n), "doc_id").select("doc_id", F.md5("summary").alias("summary"), F.md5("context").alias("context"))


@query("snapshot_names", oracle("select doc_id, page, region_idx, case when type = 'figure' then 'figure_' || lpad(cast(row_number() over (partition by doc_id, type = 'figure' order by page, region_idx) as varchar), 3, '0') || '.png' else 'region_p' || page || '_r' || region_idx || '.png' end as file from f_box", "box"))
def snapshot_names(spark, sf):
    return render.snapshots(load(spark, sf, "box"))


# --- profiles


@query("font_stats", oracle("select doc_id, round(avg(font_size), 6) as mean, round(stddev_pop(font_size), 6) as std, min(font_size) as low, max(font_size) as high, round(quantile_cont(font_size, 0.25), 6) as p25, round(quantile_cont(font_size, 0.75), 6) as p75, round(quantile_cont(font_size, 0.95), 6) as p95 from f_word group by doc_id", "word"))
def font_stats(spark, sf):
    s = profile.font_stats(load(spark, sf, "word"))
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "low", "high", *[F.round(c, 6).alias(c) for c in ("p25", "p75", "p95")])


@query("spacing_stats", oracle("with n as (select *, lead(y0) over (partition by doc_id, page order by y0, region_idx) - y1 as gap from f_box) select doc_id, page, round(coalesce(avg(gap) filter (gap > 0), 0), 6) as mean_gap, coalesce(max(gap) filter (gap > 0), 0.0) as max_gap, round(avg(y1 - y0), 6) as mean_height from n where gap is not null group by doc_id, page", "box"))
def spacing_stats(spark, sf):
    s = profile.spacing_stats(load(spark, sf, "box"))
    return s.select("doc_id", "page", F.round("mean_gap", 6).alias("mean_gap"), "max_gap", F.round("mean_height", 6).alias("mean_height"))


@query("doc_profile", oracle("""
with s as (select doc_id, page, sum((x1 - x0) * (y1 - y0)) / (612 * 792) as d, count_if(type = 'title') as ti, count_if(type in ('figure', 'table')) as v, count_if(type = 'text') as t, count(*) as n, avg((x1 - x0) * (y1 - y0)) as size from f_box group by doc_id, page)
select doc_id, page, round(d, 6) as density, case when ti > 0 and v > 0 and t > 5 and d > 0.15 then 'academic' when v > 0 and t > 3 and d > 0.12 then 'technical' when d < 0.08 and n > 10 and size < 50000 then 'form' when d > 0.15 then 'technical' when d < 0.08 then 'form' else 'technical' end as doc_type from s""", "box"))
def doc_profile(spark, sf):
    return profile.document_type(load(spark, sf, "box")).withColumn("density", F.round("density", 6))


@query("adaptive_thresholds", oracle("with f as (select doc_id, avg(font_size) + 1.5 * stddev_pop(font_size) as h from f_word group by doc_id), n as (select doc_id, page, lead(y0) over (partition by doc_id, page order by y0, region_idx) - y1 as gap from f_box), s as (select doc_id, page, coalesce(avg(gap) filter (gap > 0), 0) as g from n where gap is not null group by doc_id, page), m as (select doc_id, min(g) as merge from s group by doc_id) select doc_id, round(h, 6) as heading, round(merge, 6) as merge, 61.2 :: double as column_gap from f join m using (doc_id)", "word", "box"))
def adaptive_thresholds(spark, sf):
    t = profile.thresholds(load(spark, sf, "word"), load(spark, sf, "box"))
    return t.select("doc_id", F.round("heading", 6).alias("heading"), F.round("merge", 6).alias("merge"), F.round("column_gap", 6).alias("column_gap"))


@query("heading_by_stats", oracle("with l as (select *, avg(font_size) over (partition by doc_id) + 1.5 * stddev_pop(font_size) over (partition by doc_id) as lim from f_word) select doc_id, word_idx, font_size from l where font_size > lim + 1e-9 or regexp_matches(lower(fontname), 'bold|black|heavy')", "word"))
def heading_by_stats(spark, sf):
    w = load(spark, sf, "word")
    return profile.headings_by_stats(w, tb.bold(F.col("fontname"))).select("doc_id", "word_idx", "font_size")


@query("importance", oracle("select doc_id, page, region_idx, round((conf - min(conf) over (partition by doc_id, page)) / case when max(conf) over (partition by doc_id, page) > min(conf) over (partition by doc_id, page) then max(conf) over (partition by doc_id, page) - min(conf) over (partition by doc_id, page) else 1.0 end, 6) as importance from f_box", "box"))
def importance(spark, sf):
    return profile.importance(load(spark, sf, "box")).select("doc_id", "page", "region_idx", F.round("importance", 6).alias("importance"))


@query("confidence_filter", oracle("select b.doc_id, b.page, b.region_idx from f_box b join (select doc_id, page, quantile_cont(conf, 0.25) as q from f_box group by doc_id, page) q using (doc_id, page) where conf >= q", "box"))
def confidence_filter(spark, sf):
    return profile.sure_enough(load(spark, sf, "box")).select("doc_id", "page", "region_idx")


@query("native_text_blocks", oracle("""
with h as (select *, max(y1) over (partition by doc_id, block_no) - min(y0) over (partition by doc_id, block_no) as tall, lag(y1) over (partition by doc_id, block_no order by y0, word_idx) as prev from f_word),
p as (select *, cast(sum(case when tall > 75 and y0 - prev >= 15 then 1 else 0 end) over (partition by doc_id, block_no order by y0, word_idx rows between unbounded preceding and current row) as bigint) as part from h)
select doc_id, block_no, part, min(y0) as y0, max(y1) as y1, count(*) as n from p group by doc_id, block_no, part""", "word"))
def native_text_blocks(spark, sf):
    return profile.text_blocks(load(spark, sf, "word"))


@query("span_words", oracle(r"""
with s as (select doc_id, page * 100 + region_idx as span_no, x0, x1, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as ws from f_box),
e as (select doc_id, span_no, x0, x1, len(ws) as k, length(array_to_string(ws, '')) as chars, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from s),
b as (select *, coalesce(sum(length(word)) over (partition by doc_id, span_no order by pos rows between unbounded preceding and 1 preceding), 0) as before from e)
select doc_id, span_no, cast(pos as int) as pos, word, round(case when k = 1 then x0 else x0 + before * ((x1 - x0) / chars) + pos * (x1 - x0) * 0.02 end, 6) as x0, round(case when k = 1 then x1 else x0 + before * ((x1 - x0) / chars) + pos * (x1 - x0) * 0.02 + length(word) * ((x1 - x0) / chars) end, 6) as x1 from b""", "box"))
def span_words(spark, sf):
    s = load(spark, sf, "box").select("doc_id", (F.col("page") * 100 + F.col("region_idx")).alias("span_no"), "x0", "x1", "text")
    w = profile.span_words(s)
    return w.select("doc_id", "span_no", "pos", "word", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("paragraph_groups", oracle("""
with p as (select doc_id, page, count(*) as n, list(region_idx order by y0, region_idx) as ids, list(x0 order by y0, region_idx) as xa, list(y0 order by y0, region_idx) as ya, list(x1 order by y0, region_idx) as xb, list(y1 order by y0, region_idx) as yb from f_box where type = 'text' group by doc_id, page),
f as (select doc_id, page, 1 :: bigint as i, 2 :: bigint as j, 1 :: bigint as last, 0 as no, list_concat([0], list_transform(range(n - 1), lambda x: -1)) as out from p union all
  select f.doc_id, f.page, case when passed then i + 1 else i end, case when not passed then case when stops then n + 1 else j + 1 end when f.out[i + 1] >= 0 then n + 1 else i + 2 end,
    case when passed then i + 1 when joins then j else last end, case when passed and i < n and f.out[i + 1] < 0 then no + 1 else no end,
    case when passed and i < n and f.out[i + 1] < 0 then list_concat(list_concat(f.out[: i], [no + 1]), f.out[i + 2 :]) when joins then list_concat(list_concat(f.out[: j - 1], [no]), f.out[j + 1 :]) else f.out end
  from f join p on p.doc_id = f.doc_id and p.page = f.page, lateral (select f.j > p.n as passed, greatest(yb[i] - ya[i], 1e-9) as tall, ya[j] - yb[last] as gap, least(xb[last], xb[j]) - greatest(xa[last], xa[j]) as shared) a,
  lateral (select not passed and f.out[j] < 0 and gap > 3 * tall as stops) b,
  lateral (select not passed and not stops and f.out[j] < 0 and gap between -0.5 * tall and 1.5 * tall and (shared > 0.5 * least(xb[last] - xa[last], xb[j] - xa[j]) or abs(xa[last] - xa[j]) <= 20) as joins) c
  where i <= n)
select f.doc_id, f.page, unnest(p.ids) as region_idx, unnest(f.out) as paragraph from f join p on p.doc_id = f.doc_id and p.page = f.page where i = n + 1""", "box", recursive=True))
def paragraph_groups(spark, sf):
    return profile.paragraphs(load(spark, sf, "box"))


