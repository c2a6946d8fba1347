"""Rules of the library on small rows: thresholds, orders, repairs."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import geometry as geo
from docloom.functions import json_tools as js
from docloom.functions import text as tx
from docloom.operators import evaluation, graph, profile, providers, records, regions, routing, tables
from docloom.operators.paged import folded
from docloom.session import numbered
from docloom.sources import readers

BOX = "doc_id long, page int, region_idx int, type string, x0 double, y0 double, x1 double, y1 double, conf double, source string, text string, label string"


def boxes(spark, *rows):
    """(type, x0, y0, x1, y1[, conf, source, text]) on one page."""
    full = [(1, 1, i, r[0], *map(float, r[1:5]), *(r[5:] + (0.5, "native_pdf", "t")[len(r) - 5 :]), "") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, BOX)


def column(df, c, order="region_idx"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())] or [(1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(expression).first()[0]


def test_touching_boxes_do_not_overlap(spark):
    b = boxes(spark, ("text", 0, 0, 10, 10), ("text", 10, 0, 20, 10), ("text", 5, 5, 5, 9))
    p = regions.pairs(b, b, when=F.col("a_region_idx") < F.col("b_region_idx")).select(geo.iou("a_", "b_"), geo.gap("a_", "b_"), geo.contained("b_", "a_")).collect()
    assert [r[0] for r in p] == [0.0, 0.0, 0.0] and sorted(r[1] for r in p) == [0.0, 0.0, 5.0] and all(r[2] == 0 for r in p)


@pytest.mark.parametrize(("label", "kind"), [("tablecaption", "table"), ("figure_caption", "figure"), ("subtitle", "title"), (" TEXT ", "text"), ("h2", "heading"), ("legend", "caption"), ("what", "text"), ("page_header", "header")])
def test_labels(spark, label, kind):
    assert one(spark, regions.region_type(F.col("v")), v=label) == kind


def test_promotion_limits(spark):
    kind = lambda text, size, bold: one(spark, regions.promoted(F.lit("text"), F.col("t"), F.lit(size), F.lit(bold)), t=text)
    assert [kind("a", 14, True), kind("a", 13.9, True), kind("a", 10.9, True), kind("ABCD", 9, False), kind("ABC", 9, False), kind("A" * 80, 9, False), kind("", 20, True)] == ["title", "heading", "text", "heading", "text", "text", "text"]


def test_figure_that_holds_a_table_goes(spark):
    assert column(regions.drop_swallowing_figures(boxes(spark, ("figure", 0, 0, 100, 100), ("table", 0, 0, 100, 100), ("figure", 0, 0, 100, 79), ("text", 0, 0, 100, 100))), "region_idx") == [1, 2, 3]


def test_text_over_two_tables_goes(spark):
    assert column(regions.drop_table_spanners(boxes(spark, ("table", 0, 0, 10, 100), ("table", 0, 100, 10, 200), ("text", 0, 89, 10, 111), ("text", 0, 90, 10, 110), ("footer", 0, 0, 10, 200))), "region_idx") == [0, 1, 3, 4]


def test_covered_native_text_goes(spark):
    b = boxes(spark, ("text", 0, 0, 10, 10), ("table", 0, 0, 3, 10), ("figure", 3, 0, 6, 10), ("text", 100, 0, 110, 10), ("table", 100, 0, 105, 10), ("text", 5, 5, 5, 5))
    assert column(regions.drop_occupied_text(b), "region_idx") == [1, 2, 3, 4]


def test_clean_regions_keeps_all_sources(spark):
    b = boxes(spark, ("text", 0, 0, 10, 10, 0.5, "layout_model", "a"), ("text", 1, 1, 5, 5, 0.5, "native_pdf", "b"), ("text", 50, 50, 60, 60, 0.5, "native_pdf", " a "), ("text", 70, 70, 80, 80, 0.5, "native_pdf", "c"), ("text", 0, 0, 1, 1, 0.5, "fallback", "d"))
    assert column(regions.clean_regions(b), "region_idx") == [0, 3, 4]


def test_suppression_invariants(spark):
    rng = random.Random(1)
    rows = [("text", x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.randint(5, 40), y + rng.randint(5, 40), rng.randint(1, 9) / 10) for _ in range(40)]
    kept = regions.suppress(boxes(spark, *rows), 0.3)
    left = regions.pairs(kept, kept, when=F.col("a_region_idx") < F.col("b_region_idx")).where(geo.iou("a_", "b_") > 0.3)
    assert left.isEmpty() and 0 < kept.count() < 40
    merged = regions.merge_detections(boxes(spark, *rows))
    assert regions.pairs(merged, merged, when=F.col("a_region_idx") < F.col("b_region_idx")).where(geo.iou("a_", "b_") > 0.3).isEmpty()


def test_caption_yields_its_label(spark):
    b = boxes(spark, ("caption", 0, 0, 10, 10, 0.9, "layout_model"), ("title", 0, 0, 10, 9, 0.8, "ensemble"), ("text", 100, 0, 110, 10, 0.4))
    got = regions.merge_detections(b).orderBy("region_idx").select("type", "y1", "models").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [("title", 10.0, ["ensemble", "layout_model"]), ("text", 10.0, ["native_pdf"])]


def test_reading_orders(spark):
    b = boxes(spark, ("text", 400, 0, 500, 90), ("text", 0, 0, 100, 90), ("text", 0, 100, 100, 190), ("text", 400, 100, 500, 190), ("title", 0, 0, 600, 5))
    order = {r.region_idx: r.read_no for r in regions.reading_order(b).collect()}
    assert [order[i] for i in (1, 0, 4, 2, 3)] == [0, 1, 2, 3, 4]
    columns = boxes(spark, *[("text", x, y, x + 100, y + 80) for x in (400, 0) for y in (100, 0)])
    cut = {r.region_idx: r.read_no for r in regions.xy_cut(columns).collect()}
    assert [i for i, _ in sorted(cut.items(), key=lambda x: x[1])] == [3, 2, 1, 0]


def test_xy_cut_is_a_permutation(spark):
    rng = random.Random(2)
    rows = [(d, p, i, "text", x := float(rng.randint(0, 500)), y := float(rng.randint(0, 700)), x + rng.randint(5, 200), y + rng.randint(5, 90), 0.5, "native_pdf", "t", "") for d in range(6) for p in (1, 2) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, BOX)
    got = regions.xy_cut(df).collect()
    assert sorted((r.doc_id, r.page, r.region_idx) for r in got) == sorted(r[:3] for r in rows)
    for d in range(6):
        for p in (1, 2):
            mine = [r.read_no for r in got if (r.doc_id, r.page) == (d, p)]
            assert sorted(mine) == list(range(len(mine)))


def test_page_ranges():
    assert regions.pages_of("1-3,5,2", 4) == [1, 2, 3] and regions.pages_of("", 4) == [] and regions.pages_of("0-9", 3) == [1, 2, 3]


# --- text


@pytest.mark.parametrize(
    ("raw", "value", "rule"),
    [("USD 2,230.00", 2230.0, "iso_currency_prefix"), ("$ 10", 10.0, "symbol_prefix"), ("2.230,00", 2230.0, "european_decimal"), ("2,230.5 EUR", 2230.5, "iso_currency_suffix"), ("12", 12.0, "comma_thousands"), (",", None, None), ("$1.2.3", None, None), ("", None, None), (None, None, None), ("about 3", None, None)],
)
def test_amounts(spark, raw, value, rule):
    got = one(spark, tx.amount(F.col("v")), v=raw)
    assert (got["value"], got["rule"], got["unresolved"]) == (value, rule, value is None)


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("2024-02-31", "2024-02-31"), ("31-02-2024", "2024-02-31"), ("6/6/2025", "2025-06-06"), ("13.13.2024", None), ("06 June 2025", "2025-06-06"), ("on June 6, 2025!", "2025-06-06"), ("1/2/24", None), ("", None), (None, None)],
)
def test_dates(spark, raw, iso):
    assert one(spark, tx.date(F.col("v")), v=raw)["value"] == iso


@pytest.mark.parametrize(("raw", "code"), [("eur", "EUR"), ("USD 5", "USD"), ("abc CHF", "abc CHF"), ("₹5", "INR"), ("XYZ", "XYZ"), ("", "")])
def test_currencies(spark, raw, code):
    assert one(spark, tx.currency(F.col("v")), v=raw)["value"] == code


@pytest.mark.parametrize(("name", "kind"), [("corporate", "amount"), ("currency", "currency"), ("valid_until", "date"), ("issued_by", "date"), ("note", "string")])
def test_hints(spark, name, kind):
    assert one(spark, tx.hint(F.col("v")), v=name) == kind


def test_small_texts(spark):
    assert one(spark, tx.snake_case(F.col("v")), v="totalNetPrice") == "total_net_price"
    assert one(spark, tx.comparable(F.col("v")), v=" A <!-- x\n --> b\t C ") == "a b c"
    assert one(spark, tx.is_empty(F.col("v")), v=" \n") and one(spark, tx.is_empty(F.col("v")), v=None) and not one(spark, tx.is_empty(F.col("v")), v="x")
    assert one(spark, tx.unit_split(F.col("v")), v="24 V").asDict() == {"number": "24", "unit": "V"} and one(spark, tx.unit_split(F.col("v")), v="24") is None
    assert one(spark, tx.quoted_answer(F.col("v")), v="\n Answer: \"x y\" \nmore") == "x y"
    assert not one(spark, tx.good_quality(F.col("v")), v="" * 60) and one(spark, tx.good_quality(F.col("v")), v="zq " * 5)
    assert not one(spark, tx.good_quality(F.col("v")), v="zqx wvu " * 20)


# --- graph


def lines(spark, *rows):
    return spark.createDataFrame([(1, 1, i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, page int, region_idx int, type string, text string")


def test_heading_stack(spark):
    r = lines(spark, ("title", "T"), ("heading", "a"), ("heading", "1.2.3 b"), ("heading", "1.2.4 c"), ("heading", "d"), ("heading", "INTRO"), ("heading", "  "), ("text", "x"), ("heading", "1.1.1 e"))
    got = [r.stack for r in graph.chunked(r).orderBy("region_idx").collect()]
    assert got == [["T"], ["T", "a"], ["T", "a", "1.2.3 b"], ["T", "a", "1.2.4 c"], ["T", "d"], ["INTRO"], ["INTRO"], ["INTRO"], ["INTRO", "1.1.1 e"]]


def test_chunks(spark):
    r = lines(spark, ("text", "a" * 1200), ("text", "b"), ("text", "c"), ("table", "t"), ("figure", None), ("heading", "h" * 1300), ("text", "d"), ("footer", "f"))
    c = graph.chunked(r)
    assert column(c, "node_idx") == [0, 0, 1, 2, 3, 4, 4, 5]
    n = {x.node_idx: x for x in graph.nodes(r).collect()}
    assert [n[i].node_type for i in range(6)] == ["text", "text", "table", "figure", "text", "footer"]
    assert n[1].content.startswith("[CONTEXT: (Document Root)]\n\n... " + "a" * 148 + " b (continued)\n\nc") and "continued" not in n[2].content
    assert sum(x.region_count for x in n.values()) == 8 and all(n[i].region_count == 1 for i in (2, 3, 5))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_folds_of_any_length(spark, n):
    """Sums so far, over blocks of elements and what is left of them."""
    sums = folded(F.expr(f"sequence(1, {n})") if n else F.array().cast("array<int>"), F.struct(F.lit(0).alias("sum")), lambda s, x: (F.struct((s["sum"] + x).alias("sum")), F.struct((s["sum"] + x).alias("sum"))), "struct<sum:int>", "struct<sum:int>")
    assert [r.sum for r in spark.range(1).select(sums.alias("s")).first().s] == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_batches(spark):
    p = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((10, 30, 5, 100, 40, 1, 40))], "doc_id long, node_idx int, content string")
    assert column(graph.batches(p, 40), "batch_idx", "node_idx") == [0, 0, 1, 2, 3, 4, 5]
    one_long = spark.createDataFrame([(1, 0, "aaaa\nbb\ncccccccccccc\nd")], "doc_id long, node_idx int, content string")
    assert [(r.shard, r.chars, r.continued) for r in graph.shattered(one_long, 8).orderBy("shard").collect()] == [(0, 8, True), (1, 13, True), (2, 2, False)]


def test_links(spark):
    b = boxes(spark, ("caption", 0, 100, 50, 110), ("table", 0, 0, 50, 20), ("figure", 0, 189.9, 50, 200), ("caption", 500, 500, 510, 510))
    got = {(r.src, r.dst, r.edge_type) for r in graph.caption_links(b).collect()}
    assert got == {(0, 2, "CAPTION_OF"), (2, 0, "LINKED_TO")}
    n = spark.createDataFrame([(1, 0, "text", "see fig. 3A and Table 9"), (1, 1, "figure", "Figure 3a"), (1, 2, "table", "Table 3A"), (1, 3, "text", "none")], "doc_id long, node_idx int, node_type string, content string")
    assert {(r.src, r.dst) for r in graph.reference_links(n).collect()} == {(0, 2), (1, 2)}


# --- tables


def words(spark, *rows):
    return spark.createDataFrame([(1, i, t, float(x), float(y), float(x + 10 * len(t)), float(y + 8), 10.0, "Arial") for i, (t, x, y) in enumerate(rows)], "doc_id long, word_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, fontname string")


def test_rows_hold_to_their_first_word(spark):
    assert column(tables.row_groups(words(spark, ("a", 0, 0), ("b", 0, 3), ("c", 0, 6), ("d", 0, 9)), 5), "row_no", "word_idx") == [0, 0, 1, 1]


def test_boundaries_move(spark):
    p = spark.createDataFrame([(1, float(v)) for v in (0, 4, 7, 20)], "doc_id long, pos double")
    assert tables.merged_boundaries(p, 5).first().boundaries == [4.5, 20.0]


def test_kv_cells(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 400.0, 100.0)], "doc_id long, t_x0 double, t_y0 double, t_x1 double, t_y1 double")
    w = words(spark, ("H" * 30, 0, 0), ("k1", 10, 20), ("v1", 240, 20), ("more", 240, 40), ("k2", 10, 60), ("v2", 240, 60))
    got = [(r.row_no, r.col_no, r.text, r.is_header) for r in tables.kv_cells(w, t).orderBy("row_no", "col_no").collect()]
    assert got == [(0, 0, "H" * 30, True), (1, 0, "k1", False), (1, 1, "v1 more", False), (2, 0, "k2", False), (2, 1, "v2", False)]


def test_kv_cells_are_sequential(spark):
    """Against the rule followed word row by word row."""
    rng = random.Random(11)
    data = [(d, i, f"w{i}", x := float(rng.choice([10, 40, 300, 330])), float(20 * rng.randint(0, 7)), x + rng.choice([20, 40, 280]), 0.0, 10.0, "Arial") for d in range(30) for i in range(rng.randint(4, 18))]
    data = [(*r[:6], r[4] + 8, *r[7:]) for r in data]
    w = spark.createDataFrame(data, "doc_id long, word_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, fontname string")
    t = w.select("doc_id").distinct().selectExpr("doc_id", "0D as t_x0", "0D as t_y0", "400D as t_x1", "160D as t_y1")
    split = {r.doc_id: r.split for r in tables.column_split(w, t).collect()}
    want = set()
    for d, at in split.items():
        rows = {}
        for r in data:
            if r[0] == d:
                rows.setdefault(r[4], []).append(r)
        cells, no = [], 0
        for _, row in sorted(rows.items()):
            row.sort(key=lambda r: (r[3], r[1]))
            said = lambda part: " ".join(r[2] for r in part)
            if (max(r[5] for r in row) - min(r[3] for r in row)) / 400 > 0.7:
                cells.append([no, 0, said(row), True])
                no += 1
                continue
            left, right = [r for r in row if (r[3] + r[5]) / 2 < at], [r for r in row if (r[3] + r[5]) / 2 >= at]
            if right and not left and cells and cells[-1][1] == 1:
                cells[-1][2] += " " + said(right)
                continue
            cells += [[no, c, said(part), False] for c, part in ((0, left), (1, right)) if part]
            no += 1
        want |= {(d, *c) for c in cells}
    got = {(r.doc_id, r.row_no, r.col_no, r.text, r.is_header) for r in tables.kv_cells(w, t).collect()}
    assert len(split) > 10 and got == want


def test_merge_is_greedy(spark):
    """Against the rule followed seed by seed."""
    rng = random.Random(12)
    kinds = ["caption", "title", "text", "table", "figure"]

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        both = max(w, 0) * max(h, 0)
        return both / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both), both / ((b[3] - b[1]) * (b[4] - b[2]))

    for _ in range(4):
        rows = [(rng.choice(kinds), x := float(rng.randint(0, 50)), y := float(rng.randint(0, 50)), x + rng.randint(5, 40), y + rng.randint(5, 40), rng.randint(1, 99) / 100, "m") for _ in range(25)]
        key = lambda r: (-r[5], -(r[3] - r[1]) * (r[4] - r[2]), rows.index(r))
        left, out = sorted(rows, key=key), []
        while left:
            seed = left.pop(0)
            taken = [r for r in left if iou(seed, r)[0] > 0.3 or iou(seed, r)[1] > 0.8]
            left = [r for r in left if r not in taken]
            best = next((r for r in taken if r[0] in ("title", "text", "table") and r[5] > 0.7), seed) if seed[0] == "caption" else seed
            out.append((best[0], *seed[1:5], best[5], seed))
        kept = []
        for r in sorted(out, key=lambda r: (-r[5], -(r[3] - r[1]) * (r[4] - r[2]), rows.index(r[6]))):
            if all(iou(k, r)[0] <= 0.3 for k in kept):
                kept.append(r)
        got = {(r.type, r.x0, r.y0, r.x1, r.y1, r.conf) for r in regions.merge_detections(boxes(spark, *rows)).collect()}
        assert got == {r[:6] for r in kept}


def test_tags_and_pipes(spark):
    assert one(spark, tables.cells_of_tags(F.col("v")), v="<ROW><P>a</P><C>b</C><V>1</V></ROW><ROW><P>c</P></ROW>") == [["a", "b", "1"], ["c", "", ""]]
    assert one(spark, tables.cells_of_tags(F.col("v")), v="| a | b |\n|---|---|\n| 1 |  |") == [["a", "b"], ["1", ""]]


def test_markdown_keeps_to_the_median(spark):
    df = spark.createDataFrame([([["a", "b"], ["1"], ["2", "x|y", "z"]],)], "rows array<array<string>>")
    assert df.select(tables.markdown(F.col("rows"))).first()[0] == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | x\\|y |"


# --- records and reports


def test_merge_takes_the_first_that_says_something(spark):
    f = spark.createDataFrame([(1, 0, "a", None, 0), (1, 1, "a", " ", 0), (1, 2, "a", "x", 0), (1, 3, "a", "y", 0), (1, 0, "standards", "s", 0), (1, 1, "standards", "s", 0)], "doc_id long, batch_idx int, path string, value string, k int")
    assert {r.path: r.value for r in records.merged(f).collect()} == {"a": "x", "standards": "s"}
    assert {r.path: r["items"] for r in records.merged_lists(f).collect()} == {"a": [" ", "x", "y"], "standards": ["s"]}


def test_verification(spark):
    f = spark.createDataFrame([(1, "name", "Red  WIDGET", 0), (1, "code", "AB-1293-XZ", 1), (1, "x", "nowhere at all", 2), (1, "y", "ab", 3), (1, "status", "red widget", 4)], "doc_id long, path string, value string, k int")
    d = spark.createDataFrame([(1, "A red\nwidget, code AB-1234-XZ and so on.")], "doc_id long, text string")
    got = {r.path: (r.state, r.repair) for r in records.repaired(f, d, 0.8).collect()}
    assert got == {"name": ("verified", None), "code": ("repaired", "ab-1234-xz"), "x": ("flagged", None)}


def test_fuzzy_is_exhaustive():
    import difflib

    rng = random.Random(7)
    for _ in range(60):
        source = "".join(rng.choice("abcd ") for _ in range(60))
        at = rng.randint(0, 40)
        needle = list(source[at : at + 14])
        for _ in range(rng.randint(0, 3)):
            needle[rng.randrange(len(needle))] = rng.choice("abcdz")
        needle = "".join(needle)
        every = [difflib.SequenceMatcher(None, source[i : i + w], needle, autojunk=False).ratio() for w in range(11, 18) for i in range(len(source) - w + 1)]
        best, _ = records.fuzzy(needle, source, 0.8)
        assert best == max(every) if max(every) >= 0.8 else best is None or best < 0.8


def test_line_items(spark):
    t = spark.createDataFrame([(1, "| a | 5 |\n|---|---|\n| per unit | 3 |\n| x |\n| b |  |\nno | row |\n| curr. | 1 |")], "doc_id long, markdown string")
    assert [(r.description, r.amount) for r in records.line_items(t).orderBy("pos").collect()] == [("a", "5"), ("b", None)]


def test_page_lookup(spark):
    assert one(spark, records.page_before(F.col("s"), F.lit("NEEDLE")), s="<!-- page:1 -->x<!-- page:2 -->a needle<!-- page:3 -->needle") == 2
    assert one(spark, records.page_before(F.col("s"), F.lit("none")), s="<!-- page:1 -->") is None


def test_truth_metrics(spark):
    r = spark.createDataFrame([(1, "a", "Big Ship Ltd"), (1, "b.c", "7"), (1, "d", " ")], "doc_id long, path string, value string")
    t = spark.createDataFrame([(1, "a", "big ship"), (1, "b.c", "8"), (1, "e", "x"), (2, "a", "y")], "doc_id long, path string, expected string")
    got = {x.doc_id: x for x in evaluation.truth_metrics(r, t).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1, got[1].matched, got[1].missing) == (0.5, 0.3333, 0.4, ["a"], ["b.c", "e"])
    assert (got[2].precision, got[2].recall, got[2].f1) == (0.0, 0.0, 0.0)


def test_reports_of_one_card(spark):
    c = spark.createDataFrame([("success", 2, 0, 0, 1.0, 1.0, 0.0, None)], "status string, required_total long, required_missing_count long, parse_failure_count long, schema_validity_rate double, required_field_completion_rate double, grounded_reference_rate double, gt_field_f1 double")
    assert {r.metric: (r["mean"], r["std"], r.n) for r in evaluation.report(c).collect()} == {"schema_validity_rate": (1.0, 0.0, 1), "required_field_completion_rate": (1.0, 0.0, 1), "grounded_reference_rate": (0.0, 0.0, 1)}
    assert evaluation.success(c.limit(0)).first().success_rate == 0.0 and c.select(evaluation.failure_classes()).first()[0] == []
    assert {r.n for r in evaluation.failures(c).collect()} == {0}


# --- json, schemas, providers


@pytest.mark.parametrize(
    ("text", "value"),
    [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": 1}\n``` y', {"a": 1}), ('so {"a": [1, 2,],} end', {"a": [1, 2]}), ('{"a": {"b": 1', {"a": {"b": 1}}), ('{"a": [1, {"b": "c', {"a": [1, {"b": "c"}]}), ("none", None), ("", None), (None, None), ("[1]", None)],
)
def test_salvage(text, value):
    assert js.salvage(text) == value


def test_json_paths():
    r = {"a": {"b": [{"c": 1}]}, "d": None}
    assert (js.get(r, "a.b[0].c"), js.get(r, "a.b.0.c"), js.get(r, "a.b[3].c"), js.get(r, "d.e")) == (1, 1, None, None)
    assert js.put(r, "d.e", 5) and js.put(r, "a.b[0].x", 2) and not js.put(r, "a.b[9].x", 2)
    assert js.leaves(r) == [("a.b[0].c", 1), ("a.b[0].x", 2), ("d.e", 5)]
    assert js.last_object('{"properties": {}} then {"v": "http://x"} // no') == {"v": "http://x"}


def test_schemas():
    s = {"properties": {"n": {"type": ["integer", "null"]}, "who": {"$ref": "#/$defs/p"}, "pins": {"type": "array", "items": {"type": "object", "properties": {"Pin": {}, "Signal": {}}}}, "tags": ["x"], "any": {"type": "object"}, "odd": 5}, "$defs": {"p": {"type": "object", "properties": {"name": "string", "p": {"$ref": "#/$defs/p"}}}}}
    t = js.compiled(s)
    kinds = {f.name: f.dataType for f in t.fields}
    assert kinds["n"] == T.LongType() and kinds["pins"] == T.ArrayType(js.TYPED["PinAssignment"]) and kinds["tags"] == T.ArrayType(T.StringType()) and kinds["any"] == T.MapType(T.StringType(), T.StringType()) and kinds["odd"] == T.StringType()
    assert js.string_paths(t) == ["who.name", "odd"] and "source_evidence" in kinds and "source_evidence" not in js.compiled(s, False).fieldNames()
    assert js.typed_block({"type": "object", "properties": {"name": {}, "value": {}, "price": {}}}) is None
    assert js.coerced({"a": ["x", "y"], "b": "z", "c": None}, {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"type": "array"}}}) == {"a": "x, y", "b": ["z"], "c": []}
    assert js.example({"properties": {"a": {"type": "array", "items": {"type": "integer"}}}}) == {"a": [0]} and js.field_names(s) >= {"n", "pins", "pin", "signal"}


def test_prompts():
    assert js.renamed({"Art No": 1, "specs": 2, "x": 3, "article_number": 4}, ["art_no", "parameters"]) == {"art_no": 1, "parameters": 2, "x": 3}
    source = "a" * 900 + " serial: QX-123 " + "b" * 900
    assert "QX-123" in js.around(source, "item.serial", "QX-128", 50) and "QX-123" in js.around(source, "item.serial", None, 50) and js.around(source, "none", None, 50, 100) == "a" * 100
    assert js.around("short", "x") == "short" and js.around("", "x") == ""
    kind = js.compiled({"properties": {"a": {"type": "integer", "description": "how many"}, "o": {"type": "object", "properties": {"b": "string"}}}}, False)
    assert js.hint(kind).split("\n")[:2] == ["a: bigint - how many", "o.b: string"]
    assert json.loads(js.snapshot({"a": {"b": 1}, "l": [1, 2, 3]}, "a.b")) == {"a": {"b": "<TO_FIND>"}, "l": [1, 2, "... 1 more"]}


def test_colours_and_bypass(spark):
    assert one(spark, tx.hex_colour(F.lit(0.0), F.lit(0.5), F.lit(1.0)), v="x") == "#007fff"
    assert one(spark, tx.passed_through(F.col("v")), v="x")["norm_string"] == "x"


def test_registry(spark):
    assert {r.domain: r.family for r in routing.registry(spark).collect()} == routing.FAMILIES
    assert one(spark, routing.family(F.col("v")), v="Industrial") == "hardware_v1" and one(spark, routing.family(F.col("v")), v="Corporate") == "invoice_v1" and one(spark, routing.family(F.col("v")), v="?") == "general_v1"
    assert one(spark, routing.canonical(F.col("v")), v=" Industrial_x") == "industrial"


def test_failing_batches_fail_alone(spark):
    df = spark.createDataFrame([(1, "Invoice No 57"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.answer, r.status) for r in providers.extracted(df, "rule").collect()}
    assert json.loads(got[1][0]) == {"invoice_number": "57"} and got[1][1] == "ok" and got[2] == (None, "failed")
    assert {r.status for r in providers.extracted(df, "null").collect()} == {"failed"}


def test_ground_truth_lines(spark, tmp_path):
    (tmp_path / "gt.jsonl").write_text('{"doc_id": "a", "fields": {"x": "1"}}\nbad\n{"doc": "b", "fields": {"y": 2}}\n{"doc_id": "a", "fields": {"x": "3"}}\n')
    assert {(r.doc_id, r.path, r.expected) for r in readers.ground_truth(spark, str(tmp_path / "gt.jsonl")).collect()} == {("a", "x", "3"), ("b", "y", "2")}


def test_numbered(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.v == r.row_no for r in numbered(df, "v").collect())
    assert numbered(df.limit(0), "v").count() == 0


def test_paragraphs(spark):
    b = boxes(spark, ("text", 0, 0, 100, 10), ("text", 0, 12, 100, 22), ("text", 300, 14, 400, 24), ("text", 0, 60, 100, 70), ("title", 0, 72, 100, 80))
    assert column(profile.paragraphs(b), "paragraph") == [0, 0, 1, 2]
