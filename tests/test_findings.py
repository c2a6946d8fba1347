"""Queries against their SQL on small tables of odd rows."""

import duckdb
import pytest

import __spark_entry__
from docloom.operators import refine


def both(spark, folder, name, **tables):
    """A query's rows and its SQL's rows over tables given as SQL."""
    c = duckdb.connect()
    for table, body in tables.items():
        c.execute(f"copy ({body}) to '{folder}/{table}.parquet'")
        c.execute(f"create view {table} as from '{folder}/{table}.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()[name])
    cols = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    got = __spark_entry__.queries()[name](spark, str(folder)).collect()
    return sorted((tuple(r[c] for c in cols) for r in got), key=repr), sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


TEXTS = (
    "geäen 4991686353023889 bel", "La èen 12-3 èle", "usdé 5", "éusd", "_en 12 en_ 12", "en\x0b60529", "en 12", "iſo 9001 uſd", "rohſ ce marKed",
    "İSO 9001 DİN", "ip67é ip678", "०en 7", "éen 8", "", None,
)


def documents(texts):
    sql = ", ".join(f"({i}, {'null' if t is None else chr(39) + t + chr(39)})" for i, t in enumerate(texts))
    return f"select doc_id :: bigint as doc_id, text :: varchar as text from (values {sql}) v(doc_id, text)"


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_annotations_of_words_beside_letters_that_are_not_ascii(spark, tmp_path, turn):
    got, want = both(spark, tmp_path, "annotations", documents=documents([t for t in TEXTS for _ in range(3)][turn:]))
    assert got == want and any("en 4991686353023889" in r[3] for r in got)


def test_annotations_keep_all_standards_and_connectors(spark, tmp_path):
    text = " ".join(f"iso {n} din {n}" for n in range(100, 115)) + " m12 m8 m5 rj45 rj11 usb hdmi xlr bnc dbe d-sub ethernet serial modular circular rectangular inline"
    got, want = both(spark, tmp_path, "annotations", documents=documents(["", text, text]))
    assert got == want and [(len(c.split(",")), len(s.split(","))) for c, _, d, s in got if d == 2] == [(18, 30)]


def test_words_at_the_limit_of_headings_are_none(spark, tmp_path):
    """Where 4 of every 13 words are large, mean plus 1.5 deviations is their size but for rounding."""
    sizes = [(low, high) for low in range(5) for high in range(low + 1, 5)]
    words = ", ".join(f"({16 * (len(sizes) * n + i)}, {j % 7 + 1}, {pair[j % 13 < 4]})" for n in range(4) for i, pair in enumerate(sizes) for j in range(13 * (n + 1)))
    table = f"""select o :: bigint as l_orderkey, (4 - s % 4) % 4 :: bigint as l_partkey, s :: bigint as l_suppkey, ln :: int as l_linenumber, 1.0 :: double as l_quantity, 1.0 :: double as l_extendedprice
                from (values {words}) v(o, ln, s)"""  # the plain font: nothing is bold
    table += " union all select 1000000 + i, (4 - s % 4) % 4, s, 1, 1.0, 1.0 from (values (0, 0), (1, 0), (2, 0), (3, 0), (4, 4)) v(i, s)"
    got, want = both(spark, tmp_path, "heading_by_stats", lineitem=table)
    assert got == want and {r[0] for r in got} == {1000000 // 16}


def test_structure_cells_do_not_depend_on_the_order_of_rows(spark):
    kinds = [(1, "row", 0.0, 0.0, 100.0, 10.0 + i, 0.5) for i in range(6)] + [(1, "column", 0.0, 0.0, 10.0 + i, 100.0, 0.5) for i in range(6)]
    schema = "doc_id long, kind string, x0 double, y0 double, x1 double, y1 double, score double"
    first, second = (sorted(map(tuple, refine.structure_cells(spark.createDataFrame(rows, schema).coalesce(1)).collect())) for rows in (kinds, kinds[::-1]))
    assert first == second and [r[6] for r in first if r[2] == 5] == [10.0 + i for i in range(6)]


def test_structure_cells_number_nulls_last(spark, tmp_path):
    keys = [(8, i, p, s) for i, (p, s) in enumerate([(1, 5), (2, 6), (3, 7), (None, 8), (5, None), (6, 1), (7, 2), (8, None), (None, 3), (4, 4), (3, 2), (9, 9)])]
    rows = ", ".join(f"({o}, {ln}, {'null' if p is None else p}, {'null' if s is None else s})" for o, ln, p, s in keys)
    table = f"select o :: bigint as l_orderkey, p :: bigint as l_partkey, s :: bigint as l_suppkey, ln :: int as l_linenumber, 40.0 :: double as l_quantity, 1.0 :: double as l_extendedprice from (values {rows}) v(o, ln, p, s)"
    got, want = both(spark, tmp_path, "structure_cells", lineitem=table)
    assert got and got == want
