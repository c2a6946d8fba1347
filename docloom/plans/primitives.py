"""Queries of page primitives, flat-key scores and extractors' own limits, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.operators import evaluation as ev
from docloom.operators import primitives as op
from docloom.operators import records as rec
from docloom.operators import tables as tab
from docloom.plans.records import EMPTY
from docloom.plans.tables import _GRID, CENTRE, _grid
from docloom.sources.fixtures import load, oracle

Q: dict = {}
O: dict = {}  # noqa: E741


def query(name: str, sql: str):
    def put(f):
        Q[name], O[name] = f, sql
        return f

    return put


def _rect(a: str = "x0", b: str = "y0", c: str = "x1", d: str = "y1"):
    return F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"))


@query("word_tuples", oracle("select doc_id, word_idx - 1 as id, text, x0, y0, x1, y1, case when word_idx % 4 = 0 then 0 else block_no end as block_no, 0 as line_no, word_idx as word_no from f_word where word_idx % 9 <> 0", "word"))
def word_tuples(spark, sf):
    w = load(spark, sf, "word")
    text = F.when(F.col("word_idx") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text"))
    one = F.struct("word_idx", "x0", "y0", "x1", "y1", text.alias("text"), F.when(F.col("word_idx") % 4 != 0, F.col("block_no")).alias("block_no"), F.lit(None).cast("int").alias("line_no"), F.col("word_idx").alias("word_no"))
    return op.words(w.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("words")))


@query("drawing_items", oracle("select doc_id, line_idx as draw_no, kind, x0, y0, x1, y1, case when line_idx % 3 = 0 then 1.0 :: double else line_idx / 2 end as width from f_line where line_idx % 11 <> 0", "line"))
def drawing_items(spark, sf):
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    points = F.array(point("x0", "y0"), point("x1", "y1"))
    item = lambda cmd, p: F.struct(cmd.alias("cmd"), p.alias("points"))
    items = F.array(item(F.lit("c"), points), item(F.when(F.col("kind") == "line", "l").otherwise("re"), points), item(F.lit("l"), F.slice(points, 1, 1)))
    raw = load(spark, sf, "line").select("doc_id", F.col("line_idx").alias("draw_no"), F.when(F.col("line_idx") % 11 != 0, _rect()).alias("rect"), items.alias("items"), F.when(F.col("line_idx") % 3 != 0, F.col("line_idx") / 2).alias("width"))
    return op.drawings(raw)


@query("image_rects", oracle("select doc_id, x0 + s as x0, y0 + s as y0, x1 + s as x1, y1 + s as y1, page * 100 as width, region_idx as height from f_box, (values (0), (5)) t(s) where type = 'figure'", "box"))
def image_rects(spark, sf):
    b = load(spark, sf, "box").where("type = 'figure'")
    moved = F.struct(*[(F.col(c) + 5).alias(c) for c in ("x0", "y0", "x1", "y1")])
    one = F.struct((F.col("page") * 100).alias("width"), F.col("region_idx").alias("height"), F.array(_rect(), moved).alias("rects"))
    return op.images(b.groupBy("doc_id").agg(F.collect_list(one).alias("images")))


@query("page_sizes", "select page_id as doc_id, 1 as page, cast(page_id % 4 * 90 as bigint) as rotation, 595.0 :: double + page_id % 3 as width, 842.0 :: double as height, case when page_id % 5 <> 0 then 10.0 :: double end as crop_x0, 595.0 :: double + page_id % 3 as media_x1 from pages")
def page_sizes(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), (F.col("page_id") % 4 * 90).alias("rotation"), F.lit(0.0).alias("a"), (F.lit(595.0) + F.col("page_id") % 3).alias("b"), F.lit(842.0).alias("c"), F.lit(10.0).alias("d"))
    whole, crop = _rect("a", "a", "b", "c"), _rect("d", "d", "b", "c")
    info = op.page_info(p.select("doc_id", "page", "rotation", whole.alias("rect"), F.when(F.col("doc_id") % 5 != 0, crop).alias("cropbox"), whole.alias("mediabox")))
    return info.select("doc_id", "page", "rotation", "width", "height", F.col("cropbox.x0").alias("crop_x0"), F.col("mediabox.x1").alias("media_x1"))


@query("contour_regions", oracle("""
with b as (select doc_id, page, region_idx, type in ('table', 'figure') as ruled, x1 - x0 as w, (y1 - y0) / 2 as h from f_box),
k as (select *, case when ruled and w * h > 4990 and w > 100 and h > 50 then 'Table' when not ruled and w * h > 100 and w > 20 and h > 10 then case when h > 20 and w / h < 10 then 'Title' else 'Text' end end as type from b)
select doc_id, page, region_idx, type, case type when 'Table' then 0.7 :: double else 0.6 :: double end as confidence from k where type is not null""", "box"))
def contour_regions(spark, sf):
    b = load(spark, sf, "box").select("doc_id", "page", "region_idx", F.col("type").isin("table", "figure").alias("ruled"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), ((F.col("y1") - F.col("y0")) / 2).alias("h"), F.lit(500.0).alias("page_width"), F.lit(998.0).alias("page_height"))
    return op.contour_regions(b).select("doc_id", "page", "region_idx", "type", "confidence")


@query("flat_key_f1", oracle(f"""
with r as (select doc_id, path, arg_min(value, (batch_idx, k, value)) as value from f_field where not {EMPTY.format('value')} group by doc_id, path),
e as (select doc_id, split_part(path, '.', 1) as key, max(case when not contains(path, '.') then value end) as value from r group by 1, 2),
t as (select t.doc_id, t.path, coalesce(trim(expected) <> '' and trim(value) <> '' and (contains(lower(trim(value)), lower(trim(expected))) or contains(lower(trim(expected)), lower(trim(value)))), false) as hit from f_truth t left join e on t.doc_id = e.doc_id and t.path = e.key),
p as (select doc_id, count(*) as n, count_if(hit) as hits, coalesce(string_agg(path, ',' order by path) filter (not hit), '') as missing from t group by doc_id), f as (select doc_id, count(*) as filled from e group by doc_id),
m as (select p.doc_id, missing, case when filled > 0 then hits / filled else 0.0 end as pr, hits / n as rc from p left join f using (doc_id))
select doc_id, round(pr, 4) as precision, round(rc, 4) as recall, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end, 4) as f1, missing from m""", "field", "truth"))
def flat_key_f1(spark, sf):
    record = rec.merged(load(spark, sf, "field")).where(~ev.is_empty(F.col("value")))
    return ev.flat_metrics(record, load(spark, sf, "truth")).withColumn("missing", F.array_join("missing", ","))


@query("clean_truth", oracle("select doc_id, path, case when path = 'notes' then array_to_string(list_filter([expected, '', null, 'x'], lambda v: v <> ''), ',') else expected end as kept from f_truth where doc_id % 5 <> 0", "truth"))
def clean_truth(spark, sf):
    t = load(spark, sf, "truth")
    listed = F.col("path") == "notes"
    values = F.when(listed, F.array("expected", F.lit(""), F.lit(None), F.lit("x")))
    value = F.when(F.col("doc_id") % 5 != 0, F.when(~listed, F.col("expected")))
    kept = ev.clean_truth(t.where("doc_id % 5 <> 0 or path <> 'notes'").select("doc_id", "path", value.alias("value"), values.alias("items")))
    return kept.select("doc_id", "path", F.coalesce("value", F.array_join("items", ",")).alias("kept"))


@query("extractor_qa", oracle(f"""
with {_GRID}, u as (select g.doc_id, row_no, col_no, word_idx from g join f_word w on w.doc_id = g.doc_id and {CENTRE.format('g')}),
d as (select doc_id, word_idx, count(*) as n from u group by all), v as (select doc_id, count(*) as used, count_if(n > 1) as twice from d group by doc_id), w as (select doc_id, count(*) as words from f_word group by doc_id),
c as (select doc_id, count(*) as cells, count_if((row_no + col_no) % 3 = 0) as blank from (select distinct doc_id, row_no, col_no from u) x group by doc_id)
select doc_id, case doc_id % 3 when 0 then 'kv' when 1 then 'ruled' else 'model' end as method, round(used / words, 6) as coverage, round(twice / used, 6) as duplication, round(case doc_id % 3 when 1 then blank / cells else 0.0 end, 6) as empty_ratio,
  used / words >= 0.9 and twice / used <= 0.02 and (doc_id % 3 <> 1 or blank / cells <= 0.5) as passed from v join w using (doc_id) join c using (doc_id)""", "word"))
def extractor_qa(spark, sf):
    words = load(spark, sf, "word")
    p = geo.renamed(_grid(spark, sf), "c_").join(geo.renamed(words, "w_"), (F.col("c_doc_id") == F.col("w_doc_id")) & geo.centre_in("w_", "c_"))
    text = F.when((F.col("row_no") + F.col("col_no")) % 3 == 0, F.lit(" ")).otherwise(F.lit("x"))
    cells = p.groupBy(F.col("c_doc_id").alias("doc_id"), F.col("c_row_no").alias("row_no"), F.col("c_col_no").alias("col_no")).agg(F.collect_list("w_word_idx").alias("word_ids")).withColumn("text", text)
    method = F.element_at(F.array(F.lit("kv"), F.lit("ruled"), F.lit("model")), (F.col("doc_id") % 3 + 1).cast("int"))
    q = tab.extractor_quality(cells, words, method)
    return q.select("doc_id", "method", *[F.round(c, 6).alias(c) for c in ("coverage", "duplication", "empty_ratio")], "passed")
