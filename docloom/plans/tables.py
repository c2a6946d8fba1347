"""Queries over words, drawings, captions and tables, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import tables as op
from docloom.plans.regions import area, inter, iou
from docloom.sources.fixtures import load, oracle

Q: dict = {}
O: dict = {}  # noqa: E741
BOX = (0.0, 0.0, 600.0, 260.0)
T = "f_tab as (select distinct doc_id, 0.0 :: double as t_x0, 0.0 :: double as t_y0, 600.0 :: double as t_x1, 260.0 :: double as t_y1 from f_word)"


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


def tabs(spark, sf):
    w = load(spark, sf, "word").select("doc_id").distinct()
    return w.withColumns({f"t_{s}": F.lit(v) for s, v in zip(("x0", "y0", "x1", "y1"), BOX, strict=True)})


CENTRE = "(w.x0 + w.x1) / 2 between {0}.x0 and {0}.x1 and (w.y0 + w.y1) / 2 between {0}.y0 and {0}.y1"


@query("caption_assoc", oracle(r"""
with p as (select a.doc_id, a.page, a.region_idx as caption_idx, b.region_idx as parent_idx, b.type, least(abs(a.y0 - b.y1), abs(b.y0 - a.y1)) as distance,
  greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) as over, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) as apart from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page
  where (a.type = 'caption' or (a.type = 'text' and regexp_matches(trim(a.text), '(?i)^(Figure\s+\d+|Fig\.\s*\d+|Table\s+\d+|Diagram\s+\d+|Chart\s+\d+)'))) and b.type in ('figure', 'table'))
select doc_id, page, caption_idx, parent_idx, distance from p where distance < 60 and (over > 0 or apart < 150)
qualify row_number() over (partition by doc_id, page, caption_idx order by distance, case when type = 'figure' then 0 else 1 end, parent_idx) = 1""", "box"))
def caption_assoc(spark, sf):
    return op.caption_parents(load(spark, sf, "box"))


@query("table_anchor_nn", oracle("""
with p as (select a.doc_id, a.page, a.region_idx as table_idx, b.region_idx as text_idx, a.y0 - b.y1 as up, least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 as beside, abs(b.x0 - a.x0) as off, greatest(a.x0 - b.x1, 0) as rt, abs(a.y0 - b.y0) as lower,
  b.x1 <= a.x0 + 30 as left_of, b.x1 <= a.x1 + 200 as near from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page where a.type = 'table' and b.type in ('text', 'title', 'heading')),
s as (select *, (up between -20 and 120 or beside) and (off <= 50 or left_of) as strict from p),
d as (select *, case when strict then case when beside then rt + lower * 0.5 else sqrt(up * up + off * off) end when beside and near then rt + lower * 0.1 end as distance from s)
select doc_id, page, table_idx, text_idx, round(distance, 6) as distance from d where distance is not null qualify row_number() over (partition by doc_id, page, table_idx order by case when strict then 0 else 1 end, distance, text_idx) = 1""", "box"))
def table_anchor_nn(spark, sf):
    return op.anchor_candidates(load(spark, sf, "box")).withColumn("distance", F.round("distance", 6))


@query("table_anchors_consumed", oracle("""
with p as (select a.doc_id, a.page, a.region_idx as table_idx, b.region_idx as text_idx, a.y0 - b.y1 as up, least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0 as beside, abs(b.x0 - a.x0) as off, greatest(a.x0 - b.x1, 0) as rt, abs(a.y0 - b.y0) as lower,
  b.x1 <= a.x0 + 30 as left_of, b.x1 <= a.x1 + 200 as near from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page where a.type = 'table' and b.type in ('text', 'title', 'heading')),
s as (select *, (up between -20 and 120 or beside) and (off <= 50 or left_of) as strict from p),
d as (select *, case when strict then case when beside then rt + lower * 0.5 else sqrt(up * up + off * off) end when beside and near then rt + lower * 0.1 end as distance from s),
c as (select doc_id, page, table_idx, list(text_idx order by case when strict then 0 else 1 end, distance, text_idx) as texts, row_number() over (partition by doc_id, page order by table_idx) as k from d where distance is not null group by doc_id, page, table_idx),
f as (select doc_id, page, k, table_idx, texts[1] as text_idx, [texts[1]] as used from c where k = 1 union all
  select c.doc_id, c.page, c.k, c.table_idx, h.free, list_append(f.used, h.free) from f join c on c.doc_id = f.doc_id and c.page = f.page and c.k = f.k + 1, lateral (select list_filter(c.texts, lambda x: not list_contains(f.used, x))[1] as free) h)
select doc_id, page, table_idx, text_idx from f where text_idx is not null""", "box", recursive=True))
def table_anchors_consumed(spark, sf):
    return op.anchors(load(spark, sf, "box"))


@query("iou_best_match", oracle(f"""
with p as (select a.doc_id, a.page, a.region_idx as text_idx, b.region_idx, {iou('a.', 'b.')} as v from f_box a join f_box b on a.doc_id = b.doc_id and a.page = b.page where ((b.type = 'figure' and a.type in ('caption', 'text')) or (b.type = 'table' and a.type in ('heading', 'text'))) and {inter('a.', 'b.')} > 0)
select doc_id, page, text_idx, region_idx, round(v, 6) as iou from p where v > 0.2 qualify row_number() over (partition by doc_id, page, text_idx order by v desc, region_idx) = 1""", "box"))
def iou_best_match(spark, sf):
    box = load(spark, sf, "box")
    return op.best_matches(box, box.where("type in ('figure', 'table')")).withColumn("iou", F.round("iou", 6))


@query("dominant_font", oracle(f"""
with r as (select doc_id, b.k as region_idx, b.x0, b.y0, b.x1, b.y1 from (select distinct doc_id from f_word), (values (0, 0.0, 0.0, 300.0, 130.0), (1, 300.0, 0.0, 600.0, 130.0), (2, 0.0, 130.0, 600.0, 260.0)) b(k, x0, y0, x1, y1)),
c as (select r.doc_id, region_idx, fontname, round(font_size, 1) as font_size, count(*) as n, min(word_idx) as first from f_word w join r on w.doc_id = r.doc_id and {CENTRE.format('r')} group by all)
select doc_id, region_idx, fontname, font_size, n from c qualify row_number() over (partition by doc_id, region_idx order by n desc, first) = 1""", "word"))
def dominant_font(spark, sf):
    words = load(spark, sf, "word")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("region_idx"), *[F.lit(v).alias(s) for s, v in zip(("x0", "y0", "x1", "y1"), b, strict=True)]) for k, b in enumerate(((0.0, 0.0, 300.0, 130.0), (300.0, 0.0, 600.0, 130.0), (0.0, 130.0, 600.0, 260.0)))]))
    regions = words.select("doc_id").distinct().select("doc_id", parts.alias("r")).select("doc_id", "r.*")
    return op.dominant_fonts(regions, words)


@query("word_styles", oracle("select fontname, regexp_matches(lower(fontname), 'bold|black|heavy') as is_bold, regexp_matches(lower(fontname), 'italic|oblique') as is_italic, count(*) as n from f_word group by fontname", "word"))
def word_styles(spark, sf):
    return load(spark, sf, "word").groupBy("fontname").agg(F.count("*").alias("n")).select("fontname", op.bold(F.col("fontname")).alias("is_bold"), op.italic(F.col("fontname")).alias("is_italic"), "n")


@query("stylesheet_infer", oracle("""
with f as (select doc_id, font_size, fontname, count(*) as n, min(word_idx) as first, regexp_matches(lower(fontname), 'bold|black') as bold, cast(cast(font_size as decimal(6,1)) as varchar) || '/' || fontname as name from f_word group by doc_id, font_size, fontname),
b as (select doc_id, font_size as bs, bold as bb, name as body from f qualify row_number() over (partition by doc_id order by not bold desc, n desc, first) = 1),
h as (select f.doc_id, name, row_number() over (partition by f.doc_id order by font_size desc, bold desc, first) as k from f join b using (doc_id) where font_size > bs + 0.5 or (abs(font_size - bs) <= 0.5 and bold and not bb))
select b.doc_id, body, max(case when k = 1 then name end) as h1, max(case when k = 2 then name end) as h2, max(case when k = 3 then name end) as h3 from b left join h using (doc_id) group by b.doc_id, body""", "word"))
def stylesheet_infer(spark, sf):
    return op.stylesheet(load(spark, sf, "word"))


@query("words_in_box", oracle(f"select w.doc_id, count(*) as n, sum(length(text)) as chars from f_word w where {inter('w.', 'b.').replace('b.x0', '100.0').replace('b.y0', '50.0').replace('b.x1', '400.0').replace('b.y1', '180.0')} / nullif({area('w.')}, 0) >= 0.5 group by w.doc_id", "word"))
def words_in_box(spark, sf):
    words = load(spark, sf, "word")
    boxes = words.select("doc_id").distinct().withColumns({f"t_{s}": F.lit(v) for s, v in zip(("x0", "y0", "x1", "y1"), (100.0, 50.0, 400.0, 180.0), strict=True)})
    return op.in_table(words, boxes, 0.5).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("row_groups", oracle("""
with r as (select *, row_number() over (partition by doc_id order by y0, word_idx) as k from f_word),
f as (select doc_id, k, word_idx, y0 as anchor, 0 as row_no from r where k = 1 union all
  select r.doc_id, r.k, r.word_idx, case when abs(r.y0 - f.anchor) > 3 then r.y0 else f.anchor end, f.row_no + case when abs(r.y0 - f.anchor) > 3 then 1 else 0 end from f join r on r.doc_id = f.doc_id and r.k = f.k + 1)
select doc_id, word_idx, row_no from f""", "word", recursive=True))
def row_groups(spark, sf):
    return op.row_groups(load(spark, sf, "word"), 3).select("doc_id", "word_idx", "row_no")


@query("row_tolerance", oracle("select doc_id, greatest(3.0, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] * 0.5) as tolerance from f_word group by doc_id", "word"))
def row_tolerance(spark, sf):
    return op.row_tolerance(load(spark, sf, "word"), 0.5, 3.0)


def _positions(spark, sf):
    return load(spark, sf, "line").where("x0 = x0 and abs(x1 - x0) < 0.1 * abs(y1 - y0)").select("doc_id", ((F.col("x0") + F.col("x1")) / 2).alias("pos"))


@query("boundary_merge", oracle("""
with p as (select doc_id, (x0 + x1) / 2 as pos, row_number() over (partition by doc_id order by (x0 + x1) / 2) as k from f_line where abs(x1 - x0) < 0.1 * abs(y1 - y0)),
f as (select doc_id, k, [pos] as b from p where k = 1 union all
  select p.doc_id, p.k, case when p.pos - f.b[-1] > 5 then list_append(f.b, p.pos) else list_append(f.b[:-2], (f.b[-1] + p.pos) / 2) end from f join p on p.doc_id = f.doc_id and p.k = f.k + 1)
select doc_id, b as boundaries from f qualify row_number() over (partition by doc_id order by k desc) = 1""", "line", recursive=True))
def boundary_merge(spark, sf):
    return op.merged_boundaries(_positions(spark, sf), 5)


@query("collinear_merge", oracle("select doc_id, round_even((y0 + y1) / 2 / 3, 0) * 3 as key, round(avg((y0 + y1) / 2), 6) as place, min(least(x0, x1)) as low, max(greatest(x0, x1)) as high, count(*) as n from f_line where abs(y1 - y0) < 0.1 * abs(x1 - x0) group by 1, 2", "line"))
def collinear_merge(spark, sf):
    return op.collinear(load(spark, sf, "line").where("abs(y1 - y0) < 0.1 * abs(x1 - x0)"), "y").withColumn("place", F.round("place", 6))


_GAPS = "w as (select *, (x0 + x1) / 2 as cx from f_word), g as (select doc_id, word_idx, cx, lead(cx) over (partition by doc_id order by cx, word_idx) as nx, count(*) over (partition by doc_id) as n from w)"


@query("column_split", oracle(f"with {_GAPS} select doc_id, (cx + nx) / 2 as split, nx - cx as gap from g where (cx + nx) / 2 / 600 > 0.2 and (cx + nx) / 2 / 600 < 0.8 and nx > cx qualify row_number() over (partition by doc_id order by nx - cx desc, cx) = 1 and nx - cx >= 30", "word"))
def column_split(spark, sf):
    return op.column_split(load(spark, sf, "word"), tabs(spark, sf))


@query("kv_score", oracle(f"""
with {_GAPS}, m as (select doc_id, n, (cx + nx) / 2 as mid, nx - cx as gap from g where nx is not null qualify row_number() over (partition by doc_id order by nx - cx desc, cx) = 1),
s as (select w.doc_id, any_value(m.n) as n, any_value(m.mid) as mid, any_value(m.gap) as gap, count_if(cx < mid) as l, count_if(cx > mid) as r from w left join m using (doc_id) group by w.doc_id)
select doc_id, round(case when coalesce(n, 1) < 4 or not (mid / 600 > 0.2 and mid / 600 < 0.8) then 0.0 else least(1.0, gap / 600 * 0.7 + case when greatest(l, r) > 0 then least(l, r) / greatest(l, r) else 0 end * 0.3) end, 6) as kv_score from s""", "word"))
def kv_score(spark, sf):
    return op.kv_scores(load(spark, sf, "word"), tabs(spark, sf)).withColumn("kv_score", F.round("kv_score", 6))


_LEN = "sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))"
_RULED = f"select doc_id, round(case when count_if(abs(y1 - y0) < 0.1 * abs(x1 - x0)) < 2 or count_if(abs(x1 - x0) < 0.1 * abs(y1 - y0)) < 2 then 0.0 else least(1.0, sum(case when abs(y1 - y0) < 0.1 * abs(x1 - x0) or abs(x1 - x0) < 0.1 * abs(y1 - y0) then {_LEN} else 0 end) / 1720) end, 6) as ruled_score from f_line where kind = 'line' and {_LEN} >= 10 and doc_id in (select doc_id from f_word) group by doc_id"


@query("ruled_score", oracle(_RULED, "line", "word"))
def ruled_score(spark, sf):
    return op.ruled_scores(load(spark, sf, "line"), tabs(spark, sf)).withColumn("ruled_score", F.round("ruled_score", 6))


_MULTI = """
with f as (select distinct doc_id, unnest(range(greatest(0, cast(trunc(x0 / 600 * 100) as int)), least(99, cast(trunc(x1 / 600 * 100) as int)) + 1)) as bin from f_word),
e as (select d.doc_id, b.bin from (select distinct doc_id from f_word) d, (select unnest(range(10, 90)) as bin) b where not exists (select 1 from f where f.doc_id = d.doc_id and f.bin = b.bin)),
i as (select doc_id, bin - row_number() over (partition by doc_id order by bin) as grp from e), r as (select doc_id, grp from i group by doc_id, grp having count(*) >= 8), k as (select doc_id, count(*) as n from f_word group by doc_id)
select k.doc_id, case when n < 6 then 0 else (select count(*) from r where r.doc_id = k.doc_id) end as n_gaps from k"""


@query("multi_gap", oracle(_MULTI, "word"))
def multi_gap(spark, sf):
    return op.wide_gaps(load(spark, sf, "word"), tabs(spark, sf))


@query("anchor_words", oracle("select doc_id, " + " + ".join(f"max(case when contains(lower(text), '{a}') then 1 else 0 end)" for a in op.ANCHORS) + " as n_anchors from f_word group by doc_id", "word"))
def anchor_words(spark, sf):
    return op.anchor_words(load(spark, sf, "word"))


_KV = f"""with {_GAPS}, m as (select doc_id, n, (cx + nx) / 2 as mid, nx - cx as gap from g where nx is not null qualify row_number() over (partition by doc_id order by nx - cx desc, cx) = 1),
s as (select w.doc_id, any_value(m.n) as n, any_value(m.mid) as mid, any_value(m.gap) as gap, count_if(cx < mid) as l, count_if(cx > mid) as r from w left join m using (doc_id) group by w.doc_id)
select doc_id, case when coalesce(n, 1) < 4 or not (mid / 600 > 0.2 and mid / 600 < 0.8) then 0.0 else least(1.0, gap / 600 * 0.7 + case when greatest(l, r) > 0 then least(l, r) / greatest(l, r) else 0 end * 0.3) end as kv_score from s"""
_ANCHORS = "select doc_id, " + " + ".join(f"max(case when contains(lower(text), '{a}') then 1 else 0 end)" for a in op.ANCHORS) + " as n_anchors from f_word group by doc_id"


@query("table_route", oracle(f"""
with a as ({_ANCHORS}), k as ({_KV}), r as ({_RULED}), m as ({_MULTI})
select doc_id, case when n_anchors >= 2 or n_gaps >= 2 then 'COMPLEX' when coalesce(ruled_score, 0) > 0.4 then 'RULED' when kv_score > 0.8 then 'KV' else 'COMPLEX' end as table_type, coalesce(ruled_score, 0) as ruled_score, round(kv_score, 6) as kv_score, n_gaps, n_anchors
from a join k using (doc_id) join m using (doc_id) left join r using (doc_id)""", "word", "line"))
def table_route(spark, sf):
    return op.routed(load(spark, sf, "word"), load(spark, sf, "line"), tabs(spark, sf)).select("doc_id", "table_type", F.round("ruled_score", 6).alias("ruled_score"), F.round("kv_score", 6).alias("kv_score"), "n_gaps", "n_anchors")


@query("kv_cells", oracle(f"""
with {_GAPS}, sp as (select doc_id, (cx + nx) / 2 as split from g where (cx + nx) / 2 / 600 > 0.2 and (cx + nx) / 2 / 600 < 0.8 and nx > cx qualify row_number() over (partition by doc_id order by nx - cx desc, cx) = 1 and nx - cx >= 30),
r as (select *, row_number() over (partition by doc_id order by y0, word_idx) as k from f_word),
f as (select doc_id, k, word_idx, y0 as anchor, 0 as row_no from r where k = 1 union all
  select r.doc_id, r.k, r.word_idx, case when abs(r.y0 - f.anchor) > 5 then r.y0 else f.anchor end, f.row_no + case when abs(r.y0 - f.anchor) > 5 then 1 else 0 end from f join r on r.doc_id = f.doc_id and r.k = f.k + 1),
l as (select w.doc_id, row_no, (max(x1) - min(x0)) / 600 > 0.7 as is_header, string_agg(text, ' ' order by x0, word_idx) as whole, coalesce(string_agg(text, ' ' order by x0, word_idx) filter (cx < split), '') as key, coalesce(string_agg(text, ' ' order by x0, word_idx) filter (cx >= split), '') as value
  from w join f using (doc_id, word_idx) join sp on sp.doc_id = w.doc_id group by w.doc_id, row_no),
j as (select *, not is_header and key = '' and value <> '' and coalesce(lag(not is_header and value <> '') over (partition by doc_id order by row_no), false) as goes_on from l),
o as (select *, last_value(case when not goes_on then row_no end ignore nulls) over (partition by doc_id order by row_no rows between unbounded preceding and current row) as owner from j),
c as (select doc_id, row_number() over (partition by doc_id order by owner) - 1 as row_no, arg_min(is_header, row_no) as is_header, arg_min(whole, row_no) as whole, arg_min(key, row_no) as key, coalesce(string_agg(value, ' ' order by row_no) filter (value <> ''), '') as value from o group by doc_id, owner)
select doc_id, cast(row_no as int) as row_no, 0 as col_no, case when is_header then whole else key end as text, is_header from c where case when is_header then whole else key end <> '' union all
select doc_id, cast(row_no as int), 1, value, is_header from c where not is_header and value <> ''""", "word", recursive=True))
def kv_cells(spark, sf):
    return op.kv_cells(load(spark, sf, "word"), tabs(spark, sf))


def _grid(spark, sf):
    bounds = lambda vs: load(spark, sf, "word").select("doc_id").distinct().withColumn("boundaries", F.array(*[F.lit(float(v)) for v in vs]))
    return op.grid(bounds((0, 150, 300, 450, 600)), bounds((0, 60, 120, 180, 260)))


_GRID = "g as (select d.doc_id, r.i as row_no, c.i as col_no, c.a as x0, r.a as y0, c.b as x1, r.b as y1 from (select distinct doc_id from f_word) d, (values (0, 0.0, 60.0), (1, 60.0, 120.0), (2, 120.0, 180.0), (3, 180.0, 260.0)) r(i, a, b), (values (0, 0.0, 150.0), (1, 150.0, 300.0), (2, 300.0, 450.0), (3, 450.0, 600.0)) c(i, a, b))"


@query("grid_cells", oracle(f"with {_GRID} select g.doc_id, row_no, col_no, coalesce(string_agg(text, ' ' order by w.y0, w.x0, word_idx), '') as text, count(word_idx) as n_words from g left join f_word w on w.doc_id = g.doc_id and {CENTRE.format('g')} group by all", "word"))
def grid_cells(spark, sf):
    return op.filled(_grid(spark, sf), load(spark, sf, "word"))


@query("ruled_cells", oracle("""
with p as (select doc_id, (x0 + x1) / 2 as pos, row_number() over (partition by doc_id order by (x0 + x1) / 2) as k from f_line where abs(x1 - x0) < 0.1 * abs(y1 - y0)),
f as (select doc_id, k, [pos] as b from p where k = 1 union all select p.doc_id, p.k, case when p.pos - f.b[-1] > 5 then list_append(f.b, p.pos) else list_append(f.b[:-2], (f.b[-1] + p.pos) / 2) end from f join p on p.doc_id = f.doc_id and p.k = f.k + 1),
x as (select doc_id, b from f qualify row_number() over (partition by doc_id order by k desc) = 1)
select doc_id, i - 1 as col_no, b[i] as x0, b[i + 1] as x1 from (select doc_id, b, unnest(range(1, len(b))) as i from x)""", "line", recursive=True))
def ruled_cells(spark, sf):
    bounds = op.merged_boundaries(_positions(spark, sf), 5)
    rows = bounds.select("doc_id").withColumn("boundaries", F.array(F.lit(0.0), F.lit(1.0)))
    return op.grid(bounds, rows).select("doc_id", "col_no", "x0", "x1")


@query("table_qa", oracle(f"""
with {_GRID}, u as (select g.doc_id, row_no, col_no, word_idx from g join f_word w on w.doc_id = g.doc_id and {CENTRE.format('g')} where (row_no + col_no) % 3 <> 0 or col_no = 0),
c as (select doc_id, row_no, col_no, count(*) as n from u group by all), s as (select doc_id, row_no, count(*) as n from c group by all), m as (select doc_id, n, count(*) as k from s group by all),
q as (select doc_id, max(k) / sum(k) as row_sanity from m group by doc_id), d as (select doc_id, word_idx, count(*) as n from u group by all), v as (select doc_id, count(*) as used, count_if(n > 1) as twice from d group by doc_id), w as (select doc_id, count(*) as words from f_word group by doc_id)
select q.doc_id, round(used / words, 6) as coverage, round(twice / used, 6) as duplication, round(row_sanity, 6) as row_sanity, used / words >= 0.7 and twice / used <= 0.05 and row_sanity >= 0.8 as passed from q join v using (doc_id) join w using (doc_id)""", "word"))
def table_qa(spark, sf):
    words = load(spark, sf, "word")
    from docloom.functions import geometry as geo

    p = geo.renamed(_grid(spark, sf), "c_").join(geo.renamed(words, "w_"), (F.col("c_doc_id") == F.col("w_doc_id")) & geo.centre_in("w_", "c_"))
    cells = p.where("(c_row_no + c_col_no) % 3 <> 0 or c_col_no = 0").groupBy(F.col("c_doc_id").alias("doc_id"), F.col("c_row_no").alias("row_no"), F.col("c_col_no").alias("col_no")).agg(F.collect_list("w_word_idx").alias("word_ids"), F.max("w_text").alias("text"))
    q = op.table_quality(cells, words)
    return q.select("doc_id", *[F.round(c, 6).alias(c) for c in ("coverage", "duplication", "row_sanity")], "passed")


@query("row_sanity", oracle("with s as (select doc_id, row_no, count(*) as n from f_cell group by all), m as (select doc_id, n, count(*) as k from s group by all) select doc_id, round(max(k) / sum(k), 6) as row_sanity from m group by doc_id", "cell"))
def row_sanity(spark, sf):
    return op.row_sanity(load(spark, sf, "cell")).withColumn("row_sanity", F.round("row_sanity", 6))


@query("qa_action", oracle("select doc_id, case when status = 'success' then 'accept' when required_field_completion_rate < 0.5 then case when condition = 0 then 'rerun:tsr' else 'rerun:kv' end when gt_field_f1 > 0.1 then 'rerun:ruled' when grounded_reference_rate < 0.8 then 'rerun:tsr' else 'escalate:tsr' end as action from f_scorecard", "scorecard"))
def qa_action(spark, sf):
    s = load(spark, sf, "scorecard")
    method = F.when(F.col("condition") == 0, "kv_native").otherwise("ruled")
    return s.select("doc_id", op.next_action(F.col("status") == "success", F.col("required_field_completion_rate"), F.col("gt_field_f1"), F.col("grounded_reference_rate"), method).alias("action"))


_DENSE = """s as (select doc_id, max(row_no) as r, max(col_no) as c from f_cell group by doc_id),
d as (select s.doc_id, s.r, i.i as row_no, list(coalesce(text, '') order by j.j) as cells from s, lateral (select unnest(range(0, s.r + 1)) as i) i, lateral (select unnest(range(0, s.c + 1)) as j) j left join f_cell x on x.doc_id = s.doc_id and x.row_no = i.i and x.col_no = j.j group by s.doc_id, s.r, i.i)"""


@query("dense_rows", oracle(f"with {_DENSE} select doc_id, string_agg(array_to_string(cells, '~'), '#' order by row_no) as rows from d group by doc_id", "cell"))
def dense_rows(spark, sf):
    return op.dense_rows(load(spark, sf, "cell")).select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "#").alias("rows"))


@query("table_markdown", oracle(rf"with {_DENSE}, l as (select doc_id, row_no, '| ' || array_to_string(list_transform(cells, lambda x: replace(x, '|', '\|')), ' | ') || ' |' as line, '| ' || array_to_string(list_transform(cells, lambda x: '---'), ' | ') || ' |' as rule from d) select doc_id, string_agg(case when row_no = 0 then line || chr(10) || rule else line end, chr(10) order by row_no) as markdown from l group by doc_id", "cell"))
def table_markdown(spark, sf):
    return op.dense_rows(load(spark, sf, "cell")).select("doc_id", op.markdown(F.col("rows")).alias("markdown"))


@query("garbage_tables", oracle(r"""
with c as (select doc_id, count(*) as n, count_if(trim(text) = '') as e, count_if(regexp_matches(trim(text), '(?i)^(Cell_\d+_\d+|Col\d+|Row\d+|Column\d+|R\d+C\d+)$')) as h from f_cell group by doc_id)
select doc_id, (e + h) / n <= 0.8 and n - e - h >= 2 as valid from c""", "cell"))
def garbage_tables(spark, sf):
    return op.valid_table(load(spark, sf, "cell"))


@query("table_refine", oracle(f"""
with {T}, u as (select w.doc_id, min(x0) - 2 as a0, min(y0) - 2 as b0, max(x1) + 2 as a1, max(y1) + 2 as b1 from f_word w join f_tab t on t.doc_id = w.doc_id where greatest(least(x1, t_x1) - greatest(x0, t_x0), 0) * greatest(least(y1, t_y1) - greatest(y0, t_y0), 0) / nullif({area('w.')}, 0) >= 0.3 group by w.doc_id),
j as (select t.*, a0, b0, a1, b1, (a1 - a0) * (b1 - b0) < 600 * 260 * 0.55 as whole from f_tab t join u using (doc_id))
select doc_id, case when whole or a1 - a0 < 468 then t_x0 else a0 end as x0, case when whole or b1 - b0 < 156 then t_y0 else b0 end as y0, case when whole or a1 - a0 < 468 then t_x1 else a1 end as x1, case when whole or b1 - b0 < 156 then t_y1 else b1 end as y1 from j""", "word"))
def table_refine(spark, sf):
    return op.refined_box(load(spark, sf, "word"), tabs(spark, sf))


@query("tagged_cells", oracle(r"select doc_id, region_idx, len(regexp_extract_all('| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(text, '|', '/') || ' | 1 |', '[^\n]+')) - 1 as n_rows from f_line_text where type = 'table' and text not like '<ROW>%'", "line_text"))
def tagged_cells(spark, sf):
    t = load(spark, sf, "line_text").where("type = 'table' and text not like '<ROW>%'")
    said = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.replace("text", F.lit("|"), F.lit("/")), F.lit(" | 1 |"))
    return t.select("doc_id", "region_idx", F.size(op.cells_of_tags(said)).cast("bigint").alias("n_rows"))
