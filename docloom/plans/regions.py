"""Queries over regions, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import geometry as geo
from docloom.operators import regions as op
from docloom.sources.fixtures import load, oracle

Q: dict = {}
O: dict = {}  # noqa: E741
KEYS = "doc_id, page, region_idx"
AREA = "greatest({0}x1 - {0}x0, 0) * greatest({0}y1 - {0}y0, 0)"
INTER = "greatest(least({0}x1, {1}x1) - greatest({0}x0, {1}x0), 0) * greatest(least({0}y1, {1}y1) - greatest({0}y0, {1}y0), 0)"


def area(a: str) -> str:
    return AREA.format(a)


def inter(a: str, b: str) -> str:
    return INTER.format(a, b)


def iou(a: str, b: str) -> str:
    return f"coalesce({inter(a, b)} / nullif({area(a)} + {area(b)} - {inter(a, b)}, 0), 0)"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


TYPE_SQL = "case when lower(trim(label)) in ('title','heading','text','table','figure','caption','footer','header') then lower(trim(label)) " + " ".join(f"when {' or '.join(f'contains(lower(label), {chr(39)}{p}{chr(39)})' for p in parts)} then '{kind}'" for kind, parts in op.LABEL_PARTS) + " else 'text' end"


@query("region_type_map", oracle(f"select distinct label, {TYPE_SQL} as type, case when lower(label) = 'text' then 'Text' when contains(lower(label), 'caption') then 'Caption' else upper(label[1]) || lower(substr(label, 2)) end as shown from f_box", "box"))
def region_type_map(spark, sf):
    box = load(spark, sf, "box")
    return box.select("label", op.region_type(F.col("label")).alias("type"), op.detector_label(F.col("label")).alias("shown")).distinct()


@query("regions_from_html", oracle("select doc_id, type, count(*) as n, sum(length(text)) as chars, max(region_idx) as last_idx from f_html group by doc_id, type", "html"))
def regions_from_html(spark, sf):
    return load(spark, sf, "html").groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("region_idx").alias("last_idx"))


@query("font_promotion", oracle("""
select b.doc_id, b.page, b.region_idx, case when type <> 'text' then type when trim(text) = '' then type when bold and size >= 14 then 'title' when bold and size >= 11 then 'heading'
  when upper(text) = text and lower(text) <> text and length(text) > 3 and length(text) < 80 then 'heading' else type end as promoted
from (select *, region_idx % 2 = 0 as bold, 8 + region_idx % 9 as size from f_box) b""", "box"))
def font_promotion(spark, sf):
    box = load(spark, sf, "box")
    return box.select("doc_id", "page", "region_idx", op.promoted(F.col("type"), F.col("text"), 8 + F.col("region_idx") % 9, F.col("region_idx") % 2 == 0).alias("promoted"))


@query("iou_pairs", oracle(f"select a.doc_id, a.page, a.region_idx as a, b.region_idx as b, round({iou('a.', 'b.')}, 6) as iou from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page and a.region_idx < b.region_idx where {inter('a.', 'b.')} > 0", "box"))
def iou_pairs(spark, sf):
    box = load(spark, sf, "box")
    near = op.pairs(box, box, when=(F.col("a_region_idx") < F.col("b_region_idx")) & (geo.intersection("a_", "b_") > 0))
    return near.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("a"), F.col("b_region_idx").alias("b"), F.round(geo.iou("a_", "b_"), 6).alias("iou"))


@query("containment_pairs", oracle(f"select a.doc_id, a.page, a.region_idx as inner_idx, b.region_idx as outer_idx, round({inter('a.', 'b.')} / nullif({area('a.')}, 0), 6) as share from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page and a.region_idx <> b.region_idx where {inter('a.', 'b.')} / nullif({area('a.')}, 0) >= 0.8", "box"))
def containment_pairs(spark, sf):
    box = load(spark, sf, "box")
    near = op.pairs(box, box, when=(F.col("a_region_idx") != F.col("b_region_idx")) & (geo.contained("a_", "b_") >= 0.8))
    return near.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_region_idx").alias("inner_idx"), F.col("b_region_idx").alias("outer_idx"), F.round(geo.contained("a_", "b_"), 6).alias("share"))


@query("bbox_gap", oracle("select a.doc_id, a.page, min(round(sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2)), 6)) as nearest, count(*) as n from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page and a.region_idx < b.region_idx group by a.doc_id, a.page", "box"))
def bbox_gap(spark, sf):
    box = load(spark, sf, "box")
    near = op.pairs(box, box, when=F.col("a_region_idx") < F.col("b_region_idx"))
    return near.groupBy(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page")).agg(F.round(F.min(geo.gap("a_", "b_")), 6).alias("nearest"), F.count("*").alias("n"))


@query("page_clamp", oracle("select doc_id, page, region_idx, least(x0, 299) as x0, least(y0, 399) as y0, greatest(least(x0, 299) + 1, least(x1, 300)) as x1, greatest(least(y0, 399) + 1, least(y1, 400)) as y1 from f_box", "box"))
def page_clamp(spark, sf):
    return load(spark, sf, "box").select("doc_id", "page", "region_idx", *[c.alias(k) for k, c in geo.clamped(300.0, 400.0).items()])


@query("letterbox_restore", oracle("""
with s as (select *, 640.0 / 900 as k, (640 - trunc(700 * (640.0 / 900))) / 2 as px from f_box),
u as (select doc_id, page, region_idx, (x0 - px) / k as x0, y0 / k as y0, (x1 - px) / k as x1, y1 / k as y1 from s)
select doc_id, page, region_idx, round(greatest(x0, 0), 6) as x0, round(greatest(y0, 0), 6) as y0, round(least(x1, 700), 6) as x1, round(least(y1, 900), 6) as y1 from u
where x1 > 0 and y1 > 0 and x0 < 700 and y0 < 900 and least(x1, 700) > greatest(x0, 0) and least(y1, 900) > greatest(y0, 0)""", "box"))
def letterbox_restore(spark, sf):
    box = load(spark, sf, "box")
    scale, new_width, _ = geo.letterbox(640.0, F.lit(700.0), F.lit(900.0))
    u = box.select("doc_id", "page", "region_idx", *[c.alias(k) for k, c in geo.unletterboxed(scale, (640 - new_width) / 2, F.lit(0.0)).items()])
    inside = u.where("x1 > 0 and y1 > 0 and x0 < 700 and y0 < 900")
    cut = inside.select("doc_id", "page", "region_idx", F.greatest("x0", F.lit(0.0)).alias("x0"), F.greatest("y0", F.lit(0.0)).alias("y0"), F.least("x1", F.lit(700.0)).alias("x1"), F.least("y1", F.lit(900.0)).alias("y1")).where("x1 > x0 and y1 > y0")
    return cut.select("doc_id", "page", "region_idx", *[F.round(s, 6).alias(s) for s in geo.SIDES])


@query("px_to_pdf", oracle("select doc_id, page, region_idx, round(50 + (x0 - 10) * (300 / 900.0), 6) as x0, round(60 + (y0 - 5) * (200 / 700.0), 6) as y0, round(50 + (x1 - 10) * (300 / 900.0), 6) as x1, round(60 + (y1 - 5) * (200 / 700.0), 6) as y1 from f_box", "box"))
def px_to_pdf(spark, sf):
    box = load(spark, sf, "box").withColumns({"c_x0": F.lit(50.0), "c_y0": F.lit(60.0), "c_x1": F.lit(350.0), "c_y1": F.lit(260.0)})
    return box.select("doc_id", "page", "region_idx", *[F.round(c, 6).alias(k) for k, c in geo.cell_to_page("c_", F.lit(900.0), F.lit(700.0), F.lit(10.0), F.lit(5.0)).items()])


@query("box_scales", oracle("""
select doc_id, page, region_idx, round(x0 / (200 / 72.0), 6) as pdf_x0, cast(trunc(y0 / 792 * 1000) as int) as mil_y0, cast(trunc(x1 / 612 * 1000) as int) as mil_x1,
  round(greatest(0, x0 - greatest((x1 - x0) * 0.2, 50)), 6) as pad_x0, round(least(792, y1 + greatest((y1 - y0) * 0.2, 50)), 6) as pad_y1, round((x1 - x0) * (y1 - y0), 6) as area from f_box""", "box"))
def box_scales(spark, sf):
    mil, pad = geo.thousandths(612.0, 792.0), geo.padded(0.2, 50.0, 612.0, 792.0)
    return load(spark, sf, "box").select(
        "doc_id", "page", "region_idx", F.round(geo.scaled(200 / 72)["x0"], 6).alias("pdf_x0"), mil["y0"].alias("mil_y0"), mil["x1"].alias("mil_x1"),
        F.round(pad["x0"], 6).alias("pad_x0"), F.round(pad["y1"], 6).alias("pad_y1"), F.round(geo.area(), 6).alias("area"),
    )


@query("line_directions", oracle("select doc_id, line_idx, kind, abs(y1 - y0) < 0.1 * abs(x1 - x0) as is_horizontal, abs(x1 - x0) < 0.1 * abs(y1 - y0) as is_vertical, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) as len from f_line", "line"))
def line_directions(spark, sf):
    return load(spark, sf, "line").select("doc_id", "line_idx", "kind", geo.horizontal().alias("is_horizontal"), geo.vertical().alias("is_vertical"), F.round(geo.length(), 6).alias("len"))


@query("drop_swallowing_figures", oracle(f"select {KEYS}, type from f_box a where not (type = 'figure' and exists (select 1 from f_box b where b.doc_id = a.doc_id and b.page = a.page and b.type = 'table' and {inter('a.', 'b.')} / nullif({area('b.')}, 0) >= 0.8))", "box"))
def drop_swallowing_figures(spark, sf):
    return op.drop_swallowing_figures(load(spark, sf, "box")).select("doc_id", "page", "region_idx", "type")


@query("drop_table_spanners", oracle(f"select {KEYS}, type from f_box a where not (type in ('text','list','title','heading','caption') and (select count(*) from f_box b where b.doc_id = a.doc_id and b.page = a.page and b.type = 'table' and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > (b.y1 - b.y0) * 0.1) >= 2)", "box"))
def drop_table_spanners(spark, sf):
    return op.drop_table_spanners(load(spark, sf, "box")).select("doc_id", "page", "region_idx", "type")


@query("occupied_text_filter", oracle(f"select {KEYS}, type, source from f_box a where not (source = 'native_pdf' and type = 'text' and coalesce((select sum({inter('a.', 'b.')}) from f_box b where b.doc_id = a.doc_id and b.page = a.page and b.type in ('table', 'figure')), 0) / nullif({area('a.')}, 0) > 0.5)", "box"))
def occupied_text_filter(spark, sf):
    return op.drop_occupied_text(load(spark, sf, "box")).select("doc_id", "page", "region_idx", "type", "source")


@query("region_cleanup", oracle(f"select {KEYS}, source from f_box a where source <> 'native_pdf' or not exists (select 1 from f_box b where b.doc_id = a.doc_id and b.page = a.page and b.source in ('layout_model', 'ensemble') and ({inter('a.', 'b.')} / nullif({area('a.')}, 0) > 0.5 or trim(a.text) = trim(b.text)))", "box"))
def region_cleanup(spark, sf):
    return op.clean_regions(load(spark, sf, "box")).select("doc_id", "page", "region_idx", "source")


@query("hierarchical_assembly", oracle("select doc_id, page, region_idx, cast(row_number() over (partition by doc_id, page order by case type when 'figure' then 0 when 'table' then 1 when 'caption' then 2 when 'title' then 3 else case when source = 'native_pdf' then 5 else 4 end end, region_idx) as int) as place, type = 'figure' as is_figure, type = 'table' as is_table from f_box", "box"))
def hierarchical_assembly(spark, sf):
    from pyspark.sql import Window as W

    rank = F.when(F.col("type") == "figure", 0).when(F.col("type") == "table", 1).when(F.col("type") == "caption", 2).when(F.col("type") == "title", 3).when(F.col("source") == "native_pdf", 5).otherwise(4)
    place = F.row_number().over(W.partitionBy("doc_id", "page").orderBy(rank, "region_idx"))
    return load(spark, sf, "box").select("doc_id", "page", "region_idx", place.alias("place"), (F.col("type") == "figure").alias("is_figure"), (F.col("type") == "table").alias("is_table"))


def _nms_sql(source: str, hit: str) -> str:
    return f"""
with r as (select *, row_number() over (partition by doc_id, page order by conf desc, ({area('')}) desc, region_idx) as k from {source}),
f as (select doc_id, page, k, [struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1)] as kept, region_idx, true as keep from r where k = 1
  union all
  select r.doc_id, r.page, r.k, case when hit then f.kept else list_append(f.kept, struct_pack(x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1)) end, r.region_idx, not hit
  from f join r on r.doc_id = f.doc_id and r.page = f.page and r.k = f.k + 1,
  lateral (select len(list_filter(f.kept, lambda b: {hit})) > 0 as hit) h)
select doc_id, page, region_idx from f where keep"""


IOU_B = iou("r.", "b.")
IOU_X = iou("s.", "x.")


@query("nms", oracle(_nms_sql("f_box", f"{IOU_B} > 0.3"), "box", recursive=True))
def nms(spark, sf):
    return op.suppress(load(spark, sf, "box"), 0.3).select("doc_id", "page", "region_idx")


@query("table_dedupe", oracle(_nms_sql("(select * from f_box where type in ('table', 'figure'))", f"{IOU_B} >= 0.25"), "box", recursive=True))
def table_dedupe(spark, sf):
    return op.suppress(load(spark, sf, "box").where("type in ('table', 'figure')"), 0.25, inclusive=True).select("doc_id", "page", "region_idx")


_TAKES = f"({IOU_X} > 0.3 or coalesce({inter('s.', 'x.')} / nullif({area('x.')}, 0), 0) > 0.8)"


@query("merge_detections", oracle(f"""
with s as (select *, row_number() over (partition by doc_id, page order by conf desc, ({area('')}) desc, region_idx) as k from f_box),
every as (select doc_id, page, list(struct_pack(region_idx := region_idx, x0 := x0, y0 := y0, x1 := x1, y1 := y1, conf := conf, type := type, source := source) order by k) as rs from s group by doc_id, page),
g as (select doc_id, page, 0 :: bigint as k, rs as free, rs[:0] as taken, false as here from every union all
  select s.doc_id, s.page, s.k, case when h.here then list_filter(o.others, lambda x: not {_TAKES}) else g.free end, case when h.here then list_filter(o.others, lambda x: {_TAKES}) else g.free[:0] end, h.here
  from g join s on s.doc_id = g.doc_id and s.page = g.page and s.k = g.k + 1, lateral (select len(list_filter(g.free, lambda x: x.region_idx = s.region_idx)) > 0 as here) h, lateral (select list_filter(g.free, lambda x: x.region_idx <> s.region_idx) as others) o),
b as (select s.doc_id, s.page, s.region_idx, s.x0, s.y0, s.x1, s.y1, s.type, s.conf, case when s.type = 'caption' then list_filter(taken, lambda x: x.type in ('title', 'text', 'table') and x.conf > 0.7)[1] end as better,
  list_sort(list_distinct(list_append(list_transform(taken, lambda x: x.source), s.source))) as models from g join s on s.doc_id = g.doc_id and s.page = g.page and s.k = g.k where here),
m as (select doc_id, page, region_idx, x0, y0, x1, y1, coalesce(better.type, type) as type, coalesce(better.conf, conf) as conf, models from b), {_nms_sql('m', f'{IOU_B} > 0.3').strip().removeprefix('with ').rsplit('select', 1)[0]}
select m.doc_id, m.page, m.region_idx, m.x0, m.y0, m.x1, m.y1, m.type, m.conf, array_to_string(m.models, ',') as models from f join m on m.doc_id = f.doc_id and m.page = f.page and m.region_idx = f.region_idx where f.keep""", "box", recursive=True))
def merge_detections(spark, sf):
    return op.merge_detections(load(spark, sf, "box")).withColumn("models", F.array_join("models", ","))


@query("reading_order", oracle("select doc_id, page, region_idx, cast(row_number() over (partition by doc_id, page order by y0, case when x1 - x0 > 612 * 0.6 then 2 when (x0 + x1) / 2 < 306 then 0 else 1 end, region_idx) - 1 as int) as read_no, 'p' || page || '_r' || (row_number() over (partition by doc_id, page order by y0, case when x1 - x0 > 612 * 0.6 then 2 when (x0 + x1) / 2 < 306 then 0 else 1 end, region_idx) - 1) as region_id from f_box", "box"))
def reading_order(spark, sf):
    return op.reading_order(load(spark, sf, "box")).select("doc_id", "page", "region_idx", "read_no", "region_id")


def _gap_sql(axis: str, least: float) -> str:
    return f"""
with e as (select doc_id, page, {axis}0 as a, max({axis}1) over (partition by doc_id, page order by {axis}0, {axis}1, region_idx rows between unbounded preceding and 1 preceding) as reach from f_box)
select doc_id, page, arg_max(a - reach, (a - reach, -a)) as gap, arg_max((a + reach) / 2, (a - reach, -a)) as split from e where a - reach >= {least} and a > reach group by doc_id, page"""


@query("widest_gap_x", oracle(_gap_sql("x", 10), "box"))
def widest_gap_x(spark, sf):
    return op.widest_gap(load(spark, sf, "box"), "x", 10)


@query("widest_gap_y", oracle(_gap_sql("y", 2), "box"))
def widest_gap_y(spark, sf):
    return op.widest_gap(load(spark, sf, "box"), "y", 2)


@query("xy_cut_one_level", oracle("""
with ex as (select doc_id, page, x0 as a, max(x1) over (partition by doc_id, page order by x0, x1, region_idx rows between unbounded preceding and 1 preceding) as reach from f_box),
gx as (select doc_id, page, arg_max((a + reach) / 2, (a - reach, -a)) as split from ex where a - reach > 35 group by doc_id, page),
ey as (select doc_id, page, y0 as a, max(y1) over (partition by doc_id, page order by y0, y1, region_idx rows between unbounded preceding and 1 preceding) as reach from f_box),
gy as (select doc_id, page, arg_max((a + reach) / 2, (a - reach, -a)) as split from ey where a - reach >= 2 and a > reach group by doc_id, page)
select b.doc_id, b.page, b.region_idx, case when gx.split is not null then 'x' when gy.split is not null then 'y' else '-' end as axis, case when gx.split is not null then case when (x0 + x1) / 2 < gx.split then 0 else 1 end when gy.split is not null then case when (y0 + y1) / 2 < gy.split then 0 else 1 end else 0 end as side
from f_box b left join gx using (doc_id, page) left join gy using (doc_id, page)""", "box"))
def xy_cut_one_level(spark, sf):
    box = load(spark, sf, "box")
    gx = op.widest_gap(box, "x", 10).where("gap > 35").select("doc_id", "page", F.col("split").alias("sx"))
    gy = op.widest_gap(box, "y", 2).select("doc_id", "page", F.col("split").alias("sy"))
    j = box.join(gx, ["doc_id", "page"], "left").join(gy, ["doc_id", "page"], "left")
    side = F.when(F.col("sx").isNotNull(), ((F.col("x0") + F.col("x1")) / 2 >= F.col("sx")).cast("int")).when(F.col("sy").isNotNull(), ((F.col("y0") + F.col("y1")) / 2 >= F.col("sy")).cast("int")).otherwise(0)
    return j.select("doc_id", "page", "region_idx", F.when(F.col("sx").isNotNull(), "x").when(F.col("sy").isNotNull(), "y").otherwise("-").alias("axis"), side.alias("side"))


@query("xy_cut_full")
def xy_cut_full(spark, sf):
    return op.xy_cut(load(spark, sf, "box"))


@query("page_stats", oracle("select doc_id, page, type, count(*) as n from f_box group by doc_id, page, type", "box"))
def page_stats(spark, sf):
    return op.page_stats(load(spark, sf, "box"))


@query("doc_summary", oracle("select doc_id, count(distinct page) as n_pages, count(*) as n_regions, count_if(type = 'table') as n_tables, count_if(type = 'figure') as n_figures, round(avg(case when source = 'native_pdf' then 1.0 else 0.0 end), 6) as native_share from f_box group by doc_id", "box"))
def doc_summary(spark, sf):
    return op.document_summary(load(spark, sf, "box"))


@query("region_source_counts", oracle("select source, type, count(*) as n from f_box group by source, type", "box"))
def region_source_counts(spark, sf):
    return load(spark, sf, "box").groupBy("source", "type").agg(F.count("*").alias("n"))


@query("page_range_filter", oracle("select doc_id, page, count(*) as n from f_box where page in (1, 3, 4, 5) group by doc_id, page", "box"))
def page_range_filter(spark, sf):
    return load(spark, sf, "box").where(F.col("page").isin(*op.pages_of("3-5,1,1", 10))).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
