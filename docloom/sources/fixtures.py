"""Regions, words, drawings, records and scorecards derived from the driver's tables by arithmetic.

Each is one SQL text for two dialects, so that the oracle reads the same input. They stand in for
what a page detector would deliver; the operators take any DataFrame of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PICK = "element_at(array({}), cast({} as int) + 1)"


def _pick(duck: bool, values: tuple[str, ...], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[cast({index} as int) + 1]" if duck else _PICK.format(quoted, index)


TYPES = ("text", "text", "table", "figure", "caption", "title", "heading", "footer", "text", "list")
LABELS = ("Text", "subtitle", "Table", "figure_caption", "page_footer", "main_title", "section-header", "tablecaption", "Picture", "list_item", "running_title", "abstract")
SAYINGS = ("See Figure 3 for details", "Table 2 lists the values", "Quantity 12 pcs", "SECTION OVERVIEW", "plain words without end", "Figure 1 Overview", "Fig. 4a shows Table 2", "Ends with a stop.", "1) first item", "- bullet item")
TOKENS = ("Parameter", "Value", "24", "V", "max.", "Signal", "Pin", "red", "12.5", "mA", "IP67", "name", "conditions")
FONTS = ("Arial", "Arial-Bold", "Times-Italic", "Helvetica-BoldOblique")
DOMAINS = ("", "invoice total currency usd", "supply voltage connector m12 pinout datasheet", "abstract methodology references", "agreement hereby clause party", "quotation port of loading container freight", "patient diagnosis physician", "table of contents chapter 3 installation troubleshooting procedure", "art no gtin cable length packaging unit")


def sql(name: str, duck: bool, sf_dir: str = "") -> str:
    """The text of a fixture, for DuckDB's views or for Spark's files."""
    t = lambda x: x if duck else f"parquet.`{sf_dir}/{x}.parquet`"
    div = "//" if duck else "div"
    lines = f"row_number() over (partition by l_orderkey {div} {{n}} order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
    s = "varchar" if duck else "string"
    if name == "box":
        return f"""
select doc_id, page, cast(row_number() over (partition by doc_id, page order by o, ln, p, s, e, q) as int) as region_idx, type, label, x0, y0, x0 + w as x1, y0 + h as y1, conf, source, text
from (select l_orderkey {div} 4 as doc_id, cast(1 + l_orderkey % 2 as int) as page, l_orderkey as o, l_linenumber as ln, l_partkey as p, l_suppkey as s, l_extendedprice as e, l_quantity as q,
  {_pick(duck, TYPES, "(l_partkey + l_linenumber) % 10")} as type, {_pick(duck, LABELS, "(l_partkey * 3 + l_suppkey) % 12")} as label,
  cast((l_partkey * 37) % 400 as double) as x0, cast((l_suppkey * 53 + l_linenumber * 97) % 640 as double) as y0,
  cast(40 + (l_partkey % 7) * 45 as double) as w, cast(12 + (cast(l_quantity as int) % 9) * 18 as double) as h,
  cast(30 + l_partkey % 70 as double) / 100 as conf, {_pick(duck, ("native_pdf", "layout_model", "ensemble", "native_pdf"), "l_suppkey % 4")} as source,
  {_pick(duck, SAYINGS, "(l_partkey + l_suppkey) % 10")} as text
  from {t("lineitem")}) b"""
    if name == "word":
        return f"""
select doc_id, cast({lines.format(n=16)} as int) as word_idx, text, x0, y0, x0 + 6 * length(text) as x1, y0 + 10 as y1, font_size, fontname, block_no
from (select l_orderkey {div} 16 as doc_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  {_pick(duck, TOKENS, "(l_partkey + l_linenumber) % 13")} as text, cast((l_partkey * 29) % 520 as double) as x0, cast(20 * (l_suppkey % 12) + l_linenumber % 4 as double) as y0,
  cast(8 + (l_suppkey % 5) * 2 as double) as font_size, {_pick(duck, FONTS, "(l_partkey + l_suppkey) % 4")} as fontname, cast(l_suppkey % 6 as int) as block_no
  from {t("lineitem")}) w"""
    if name == "line":
        return f"""
select o_orderkey {div} 16 as doc_id, cast(o_orderkey % 16 as int) as line_idx, {_pick(duck, ("line", "line", "line", "rect"), "o_custkey % 4")} as kind,
  cast(case when o_custkey % 2 = 0 then 0 else 50 * (o_custkey % 12) end as double) as x0, cast(case when o_custkey % 2 = 0 then 20 * (o_custkey % 12) else 0 end as double) as y0,
  cast(case when o_custkey % 2 = 0 then 100 + o_custkey % 500 else 50 * (o_custkey % 12) + o_custkey % 3 end as double) as x1,
  cast(case when o_custkey % 2 = 0 then 20 * (o_custkey % 12) + o_custkey % 5 else 50 + o_custkey % 200 end as double) as y1
from {t("orders")}"""
    if name == "html":
        rx = "<(?:h1|b|p|li|footer|title|a)[^>]*>[^<]+"
        tag, body = ("regexp_extract(m, '<([a-z0-9]+)', 1)", "regexp_extract(m, '>([^<]+)', 1)")
        src = f"select page_id as doc_id, unnest(regexp_extract_all(html, '{rx}')) as m, generate_subscripts(regexp_extract_all(html, '{rx}'), 1) as i from pages" if duck else f"select page_id as doc_id, m, i + 1 as i from {t('pages')} lateral view posexplode(regexp_extract_all(html, '{rx}', 0)) e as i, m"
        return f"""
select doc_id, 1 as page, cast(i as int) as region_idx, tag, case tag when 'title' then 'title' when 'h1' then 'heading' when 'footer' then 'footer' when 'a' then 'caption' when 'li' then 'list' else 'text' end as type,
  body as text, 20.0 * i as y0 from (select doc_id, i, {tag} as tag, {body} as body from ({src}) a) b where length(body) > 1"""
    if name == "line_text":
        src = "select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as i from documents" if duck else f"select doc_id, t as text, i + 1 as i from {t('documents')} lateral view posexplode(split(text, '\\n')) e as i, t"
        head = "case when i = 1 then 'title' when contains(text, ' | ') then 'table' when contains(text, 'icense') or contains(text, 'rights reserved') then 'footer' when length(text) < 60 then 'heading' when i % 7 = 0 then 'figure' when i % 11 = 0 then 'caption' else 'text' end"
        return f"select doc_id, cast(i as int) as region_idx, {head} as type, text from ({src}) a where length(text) > 0"
    if name == "amount":
        cents = "cast(round(o_totalprice * 100) as bigint)"
        whole, part = f"cast({cents} {div} 100 as {s})", f"lpad(cast({cents} % 100 as {s}), 2, '0')"
        grouped = f"concat(cast(({cents} {div} 100) {div} 1000 as {s}), '{{0}}', lpad(cast(({cents} {div} 100) % 1000 as {s}), 3, '0'), '{{1}}', {part})"
        en, eu = grouped.format(",", "."), grouped.format(".", ",")
        cases = [f"concat('USD ', {en})", f"concat('$ ', {en})", f"concat({en}, ' EUR')", eu, en, f"concat({whole}, '.', {part})", f"concat('about ', {whole})", f"concat('€', {whole})", "'n/a'", f"concat({whole}, ' gbp')", "''", "null"]
        pick = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
        return f"select o_orderkey as doc_id, case o_orderkey % {len(cases)} {pick} end as raw from {t('orders')}"
    if name == "date":
        y, m, d = (f"cast(extract({x} from o_orderdate) as int)" for x in ("year", "month", "day"))
        p2, p4 = (lambda x: f"lpad(cast({x} as {s}), 2, '0')"), (lambda x: f"cast({x} as {s})")
        months = ("January", "Feb", "March", "Apr", "May", "June", "Jul", "August", "Sep", "October", "Nov", "December")
        mon = _pick(duck, months, f"{m} - 1")
        cases = [f"concat({p4(y)}, '-', {p2(m)}, '-', {p2(d)})", f"concat({p2(d)}, '/', {p2(m)}, '/', {p4(y)})", f"concat({p4(d)}, '.', {p4(m)}, '.', {p4(y)})", f"concat({p4(d)}, ' ', {mon}, ' ', {p4(y)})", f"concat({mon}, ' ', {p4(d)}, ', ', {p4(y)})", f"concat('due ', {p4(d)}, ' ', {mon}, ', ', {p4(y)}, ' at noon')", f"concat('13-', {p4('25')}, '-', {p4(y)})", "'31-02-2024'", "'soon'", "null"]
        pick = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
        return f"select o_orderkey as doc_id, case o_orderkey % {len(cases)} {pick} end as raw from {t('orders')}"
    if name == "currency":
        cases = ("eur", "USD 2,230", "$ 5", "£7", "XYZ 10", "gbp", "price in CHF only", "nothing", "", "¥100 JPY")
        return f"select o_orderkey as doc_id, {_pick(duck, cases, 'o_orderkey % 10')} as raw from {t('orders')}"
    if name == "scorecard":
        return f"""
select o_orderkey as doc_id, {_pick(duck, ("success", "success", "failed", "success", "pipeline_error"), "o_custkey % 5")} as status, cast(o_custkey % 4 as bigint) as required_total,
  cast(case when o_custkey % 4 = 0 then 0 else (o_orderkey % (1 + o_custkey % 4)) end as bigint) as required_missing_count, cast(case when o_orderkey % 7 = 0 then 1 + o_custkey % 3 else 0 end as bigint) as parse_failure_count,
  case when o_orderkey % 3 = 0 then 0.0 else 1.0 end * cast(1 as double) as schema_validity_rate, cast(o_custkey % 11 as double) / 10 as required_field_completion_rate,
  cast(o_orderkey % 2 as double) as grounded_reference_rate, cast(case when o_orderkey % 13 = 0 then null else o_custkey % 101 end as double) / 100 as gt_field_f1, cast(o_orderkey % 4 as int) as condition
from {t("orders")}"""
    if name == "field":
        paths = ("vendor.name", "total_price", "notes", "issued_date", "items.0.code", "summary", "currency", "page_references")
        return f"""
select l_orderkey {div} 4 as doc_id, cast(l_linenumber as int) as batch_idx, {_pick(duck, paths, "(l_partkey + l_linenumber) % 8")} as path,
  case when (l_partkey + l_suppkey) % 6 = 0 then null when (l_partkey + l_suppkey) % 6 = 1 then '  ' else concat({_pick(duck, TOKENS, "(l_partkey + l_linenumber) % 13")}, ' ', cast(l_suppkey % 9 as {s})) end as value,
  cast(l_suppkey % 12 as int) as page, l_partkey as k from {t("lineitem")}"""
    if name == "truth":
        paths = ("vendor.name", "total_price", "notes", "issued_date", "items.0.code", "summary")
        return f"select o_orderkey {div} 4 as doc_id, {_pick(duck, paths, 'o_custkey % 6')} as path, max({_pick(duck, TOKENS, 'o_custkey % 13')}) as expected from {t('orders')} group by 1, 2"
    if name == "domain_text":
        parts = ("lower(text)" if duck else "lower(replace(text, 'İ', 'i'))", _pick(duck, DOMAINS, "doc_id % 9"), _pick(duck, DOMAINS, "(doc_id // 9) % 9" if duck else "(doc_id div 9) % 9"))
        a, b, c = parts if duck else (f"coalesce({x}, '')" for x in parts)  # DuckDB's concat leaves out nulls, its lower case of İ is one letter
        return f"select doc_id, concat({a}, ' ', {b}, ' ', {c}) as text from {t('documents')}"
    if name == "cell":
        return f"""
select doc_id, row_no, col_no, max(text) as text, count(*) as n_words from (
  select l_orderkey {div} 16 as doc_id, cast(l_suppkey % 4 as int) as row_no, cast(l_partkey % 3 as int) as col_no,
    case when (l_partkey + l_suppkey) % 7 = 0 then '' when (l_partkey + l_suppkey) % 7 = 1 then concat('Cell_', cast(l_suppkey % 4 as {s}), '_', cast(l_partkey % 3 as {s})) when (l_partkey + l_suppkey) % 7 = 2 then 'a|b' else {_pick(duck, TOKENS, "(l_partkey + l_linenumber) % 13")} end as text
  from {t("lineitem")}) c group by doc_id, row_no, col_no"""
    raise KeyError(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(sql(name, False, sf_dir))


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL over fixtures, which body may read by their names prefixed with f_."""
    if not names:
        return body.strip()
    ctes = ", ".join(f"f_{n} as ({sql(n, True)})" for n in names)
    inner = body.strip()
    if inner.lower().startswith("with "):
        inner = ", " + inner[5:]
    return f"with {'recursive ' if recursive else ''}{ctes} {inner}"
