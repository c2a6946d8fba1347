"""Queries of scalar functions over text, amounts, dates and currencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
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




@query("text_class", oracle(r"""
select doc_id, region_idx, case when (8 + region_idx % 9 >= 14 or region_idx % 5 = 0) and length(text) < 100 and not ends_with(text, '.') then 'heading'
  when regexp_matches(text, '^\s*[•\-*]\s+') or regexp_matches(text, '^\s*\d+[.)]\s+') then 'list'
  when regexp_matches(text, '(?i)^(Figure|Table|Diagram|Chart)\s+\d+') then 'caption'
  when contains(text, chr(9)) or contains(text, '|') or len(regexp_extract_all(text, '\s{3,}')) > 2 then 'table_text' else 'paragraph' end as class from f_line_text""", "line_text"))
def text_class(spark, sf):
    t = load(spark, sf, "line_text")
    return t.select("doc_id", "region_idx", tx.content_class(F.col("text"), 8 + F.col("region_idx") % 9, F.col("region_idx") % 5 == 0).alias("class"))


@query("text_role", oracle(f"""
with t as (select doc_id, region_idx, {STRIP.format('text')} as t, 8 + region_idx % 9 as size from f_line_text)
select doc_id, region_idx, case when t = '' and false then 'paragraph' when length(t) < 10 then 'label' when size > 14 and length(t) < 100 then 'heading' when length(t) < 100 then case when regexp_matches(t, '[.!?]$') then 'paragraph' else 'heading' end else 'paragraph' end as role from t""", "line_text"))
def text_role(spark, sf):
    return load(spark, sf, "line_text").select("doc_id", "region_idx", tx.role(F.col("text"), 8 + F.col("region_idx") % 9).alias("role"))


@query("list_items", oracle(r"select doc_id, page, region_idx, case when regexp_matches(text, '^\s*[•\-*+◦▪▫]\s') then 'bullet' when regexp_matches(text, '^\s*\d+[.)]\s') then 'numbered' end as list_type from f_box", "box"))
def list_items(spark, sf):
    return load(spark, sf, "box").select("doc_id", "page", "region_idx", tx.list_kind(F.col("text")).alias("list_type"))


@query("footnotes", oracle(r"""
select doc_id, page, region_idx, y0 > max(y1) over (partition by doc_id, page) * 0.9 and 6 + region_idx % 8 < 10 as is_footnote,
  regexp_matches(trim(text), '(?i)^(Figure|Fig\.|Table|Diagram)\s+\d+') as is_caption from f_box""", "box"))
def footnotes(spark, sf):
    from pyspark.sql import Window as W

    low = F.max("y1").over(W.partitionBy("doc_id", "page"))
    return load(spark, sf, "box").select(
        "doc_id", "page", "region_idx", ((F.col("y0") > low * 0.9) & (6 + F.col("region_idx") % 8 < 10)).alias("is_footnote"), F.trim("text").rlike(r"(?i)^(Figure|Fig\.|Table|Diagram)\s+\d+").alias("is_caption")
    )


@query("text_quality", oracle("""
with w as (select doc_id, text, regexp_extract_all(lower(text), '[a-z]{2,}') as ws from documents)
select doc_id, case when length(text) < 50 then true when (length(text) - length(regexp_replace(text, '[\\x{E000}-\\x{F8FF}]', '', 'g'))) / length(text) > 0.01 then false when len(ws) < 10 then true
  else len(list_filter(ws, lambda x: x in ('the','and','of','in','to','a','is','that','for','it','with','on','as','are','be','this','was','at','by','an'))) / len(ws) >= 0.15 end as good from w"""))
def text_quality(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", tx.good_quality(F.col("text")).alias("good"))


@query("clean_text", oracle(r"""
select doc_id, region_idx, md5(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g')) as cleaned,
  regexp_replace(regexp_replace(replace(text, '|', '\|'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as cell from f_line_text""", "line_text"))
def clean_text(spark, sf):
    t = load(spark, sf, "line_text")
    return t.select("doc_id", "region_idx", F.md5(tx.clean(F.col("text"))).alias("cleaned"), tx.cell_escaped(F.col("text")).alias("cell"))


@query("comparable_text", oracle(r"select page_id as doc_id, md5(lower(trim(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '\s+', ' ', 'g')))) as h from pages"))
def comparable_text(spark, sf):
    # ASCII letters only differ in case between the engines' rules for titles; the hash covers the whole page
    return spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.md5(tx.comparable(F.col("html"))).alias("h"))


@query("text_preview", oracle("""
select doc_id, md5(case when length(text) <= 2000 then text else substr(text, 1, 1000) || chr(10) || '[...middle...]' || chr(10) || substr(text, cast(trunc(length(text) / 2) as bigint) - 250 + 1, 500) || chr(10) || '[...tail...]' || chr(10) || substr(text, length(text) - 500 + 1, 500) end) as preview from documents"""))
def text_preview(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(tx.sample_of(F.col("text"), 2000)).alias("preview"))


_AMOUNT = []
for _name, _rx, _sure, _how in tx.AMOUNT_RULES:
    _d = f"regexp_extract(s, '(?i){_rx}', 1)"
    _v = f"replace(replace({_d}, '.', ''), ',', '.')" if _how == "european" else _d if _how == "plain" else f"replace({_d}, ',', '')"
    _AMOUNT.append((_name, f"regexp_matches(s, '(?i){_rx}') and try_cast({_v} as double) is not null", f"try_cast({_v} as double)", _sure))


def _amount(part: int) -> str:
    shown = {0: lambda a: f"'{a[0]}'", 1: lambda a: a[2], 2: lambda a: str(a[3])}[part]
    return "case " + " ".join(f"when {a[1]} then {shown(a)}" for a in _AMOUNT) + (" else 0.0 end" if part == 2 else " end")


@query("norm_amount", oracle(f"with t as (select doc_id, raw, {STRIP.format('raw')} as s from f_amount) select doc_id, {_amount(1)} as amount, {_amount(0)} as rule, cast(coalesce({_amount(2)}, 0.0) as double) as confidence, coalesce({_amount(2)}, 0.0) < 0.65 as unresolved from t", "amount"))
def norm_amount(spark, sf):
    read = load(spark, sf, "amount").select("doc_id", tx.amount(F.col("raw")).alias("a"))
    return read.select("doc_id", F.col("a.value").alias("amount"), "a.rule", "a.confidence", "a.unresolved")


_MONTH_NO = lambda x: f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({x}, 1, 3)))"
_DMY, _NAT, _MDY = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", rf"(?i)(\d{{1,2}})\s+{tx.MONTH}[\s,]+(\d{{4}})", rf"(?i){tx.MONTH}\s+(\d{{1,2}})[\s,]+(\d{{4}})"


def _g(rx: str, i: int) -> str:
    return f"regexp_extract(s, '{rx}', {i})"


def _isodate(y: str, m: str, d: str) -> str:
    return f"lpad({y}, 4, '0') || '-' || lpad(cast({m} as varchar), 2, '0') || '-' || lpad({d}, 2, '0')"


_FITS = f"regexp_matches(s, '{_DMY}') and try_cast({_g(_DMY, 2)} as int) between 1 and 12 and try_cast({_g(_DMY, 1)} as int) between 1 and 31"
_DATE_CASES = (
    (r"regexp_matches(s, '^\d{4}-\d{2}-\d{2}$')", "s", "iso_passthrough", "1.0"), (_FITS, _isodate(_g(_DMY, 3), f"cast({_g(_DMY, 2)} as int)", _g(_DMY, 1)), "dmy_to_iso", "0.85"),
    (f"regexp_matches(s, '{_NAT}')", _isodate(_g(_NAT, 3), _MONTH_NO(_g(_NAT, 2)), _g(_NAT, 1)), "natural_dmy_to_iso", "0.9"),
    (f"regexp_matches(s, '{_MDY}')", _isodate(_g(_MDY, 3), _MONTH_NO(_g(_MDY, 1)), _g(_MDY, 2)), "natural_mdy_to_iso", "0.88"),
)


@query("norm_date", oracle(f"""
with t as (select doc_id, {STRIP.format('raw')} as s from f_date)
select doc_id, case {' '.join(f'when {c} then {v}' for c, v, _, _ in _DATE_CASES)} end as iso, case {' '.join(f"when {c} then '{r}'" for c, _, r, _ in _DATE_CASES)} end as rule,
  cast(case {' '.join(f'when {c} then {p}' for c, _, _, p in _DATE_CASES)} else 0 end as double) as confidence from t""", "date"))
def norm_date(spark, sf):
    read = load(spark, sf, "date").select("doc_id", tx.date(F.col("raw")).alias("d"))
    return read.select("doc_id", F.col("d.value").alias("iso"), "d.rule", F.col("d.confidence").cast("double").alias("confidence"))


_CODES = ", ".join(f"'{c}'" for c in tx.CURRENCY_CODES)


@query("norm_currency", oracle(rf"""
with t as (select doc_id, raw, upper(trim(raw)) as s, regexp_extract(upper(trim(raw)), '\b([A-Z]{{3}})\b', 1) as m from f_currency)
select doc_id, case when s in ({_CODES}) then s when m in ({_CODES}) then m {' '.join(f"when contains(s, '{a}') then '{b}'" for a, b in tx.CURRENCY_SIGNS)} else trim(raw) end as currency,
  case when s in ({_CODES}) then 'known_iso_currency' when m in ({_CODES}) then 'currency_extracted_from_amount' {' '.join(f"when contains(s, '{a}') then 'currency_symbol_to_iso'" for a, _ in tx.CURRENCY_SIGNS)} end as rule from t""", "currency"))
def norm_currency(spark, sf):
    c = tx.currency(F.col("raw"))
    return load(spark, sf, "currency").select("doc_id", c["value"].alias("currency"), c["rule"].alias("rule"))


@query("field_hint", oracle("select distinct path, case " + " ".join(f"when regexp_matches(path, '(?i){w}') then '{k}'" for k, w in tx.HINTS) + " else 'string' end as hint from f_field", "field"))
def field_hint(spark, sf):
    return load(spark, sf, "field").select("path", tx.hint(F.col("path")).alias("hint")).distinct()


@query("norm_payload", oracle(rf"""
with t as (select doc_id, batch_idx, k, path, value, {STRIP.format('value')} as s, case when regexp_matches(path, '(?i){tx.HINTS[0][1]}') then 'amount' when regexp_matches(path, '(?i){tx.HINTS[1][1]}') then 'currency' when regexp_matches(path, '(?i){tx.HINTS[2][1]}') then 'date' else 'string' end as hint
  from f_field where value is not null and path <> 'page_references')
select doc_id, batch_idx, k, path, hint, case when hint = 'amount' then {_amount(1)} end as norm_double,
  case hint when 'string' then regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') when 'amount' then case when coalesce({_amount(2)}, 0.0) < 0.65 then s end end as norm_string from t where hint in ('string', 'amount')""", "field"))
def norm_payload(spark, sf):
    f = load(spark, sf, "field").where("value is not null and path <> 'page_references'").withColumn("hint", tx.hint(F.col("path"))).where("hint in ('string', 'amount')")
    return f.withColumn("v", tx.normalized(F.col("value"), F.col("hint"))).select("doc_id", "batch_idx", "k", "path", "hint", "v.norm_double", "v.norm_string")


@query("unit_split", oracle(r"""
with t as (select word_idx, doc_id, trim(case when word_idx % 3 = 0 then cast(word_idx as varchar) || ' ' || text when word_idx % 3 = 1 then cast(word_idx as varchar) || '.5mA' else text end) as v from f_word)
select doc_id, word_idx, case when regexp_matches(v, '^([\d.,\-+\s/]+)\s*([a-zA-Z°Ω%µ\d]*[a-zA-Z°Ω%µ][²³]?)$') then trim(regexp_extract(v, '^([\d.,\-+\s/]+)\s*([a-zA-Z°Ω%µ\d]*[a-zA-Z°Ω%µ][²³]?)$', 1)) end as number,
  case when regexp_matches(v, '^([\d.,\-+\s/]+)\s*([a-zA-Z°Ω%µ\d]*[a-zA-Z°Ω%µ][²³]?)$') then regexp_extract(v, '^([\d.,\-+\s/]+)\s*([a-zA-Z°Ω%µ\d]*[a-zA-Z°Ω%µ][²³]?)$', 2) end as unit from t""", "word"))
def unit_split(spark, sf):
    i = F.col("word_idx")
    value = F.when(i % 3 == 0, F.concat_ws(" ", i.cast("string"), "text")).when(i % 3 == 1, F.concat(i.cast("string"), F.lit(".5mA"))).otherwise(F.col("text"))
    u = tx.unit_split(value)
    return load(spark, sf, "word").select("doc_id", "word_idx", u["number"].alias("number"), u["unit"].alias("unit"))


@query("unit_detection", oracle("select text, case " + " ".join(f"when contains(text, '{u}') then '{u}'" for u in tx.UNITS) + " end as unit, count(*) as n from f_word group by 1, 2", "word"))
def unit_detection(spark, sf):
    return load(spark, sf, "word").select("text", tx.unit_of(F.col("text")).alias("unit")).groupBy("text", "unit").agg(F.count("*").alias("n"))


@query("snake_names", oracle("select event_type, lower(regexp_replace(event_type || 'CountValue', '(.)([A-Z])', '\\1_\\2', 'g')) as name, count(*) as n from events group by 1, 2"))
def snake_names(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_type", tx.snake_case(F.concat("event_type", F.lit("CountValue"))).alias("name")).groupBy("event_type", "name").agg(F.count("*").alias("n"))


@query("empty_values", oracle(r"select path, count_if(value is null or regexp_replace(value, '^\s+|\s+$', '', 'g') = '') as empty, count(*) as n from f_field group by path", "field"))
def empty_values(spark, sf):
    return load(spark, sf, "field").groupBy("path").agg(F.count_if(tx.is_empty(F.col("value"))).alias("empty"), F.count("*").alias("n"))


@query("text_windows", oracle("select doc_id, w as window_no, md5(substr(text, cast(w * 3000 + 1 as bigint), 3000)) as h from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / 3000.0) as bigint)))) as w from documents)"))
def text_windows(spark, sf):
    last = F.greatest(F.lit(0), F.ceil(F.length("text") / 3000).cast("int") - 1)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("window_no", F.explode(F.sequence(F.lit(0), last)))
    return docs.select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.md5(F.col("text").substr(F.col("window_no") * 3000 + 1, F.lit(3000))).alias("h"))
