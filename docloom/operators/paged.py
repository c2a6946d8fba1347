"""Scans over the ordered rows of one document or page: folds in the JVM, and Python functions without a DataFrame for each page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Elements that one inner fold goes over.
BLOCK = 256


def folded(rows: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], state: str, found: str) -> Column:
    """What a fold finds for each element of an array, in order: step takes (state, element) and returns (next state, found).

    Spark copies a fold's accumulator at every step. So an inner fold gathers what a block of
    elements gives, and only the outer one, a step for each block, holds it all.
    """
    inner = f"struct<s:{state},out:array<{found}>>"
    outer = f"struct<now:{inner},full:array<array<{found}>>>"
    none = F.array().cast(f"array<{found}>")

    def both(acc: Column, row: Column) -> Column:
        after, got = step(acc["s"], row)
        return F.struct(after.alias("s"), F.concat(acc["out"], F.array(got.cast(found))).alias("out")).cast(inner)

    def block(acc: Column, part: Column) -> Column:
        now = F.aggregate(part, F.struct(acc["now"]["s"].alias("s"), none.alias("out")).cast(inner), both)
        return F.struct(now.alias("now"), F.concat(acc["full"], F.array(acc["now"]["out"])).alias("full")).cast(outer)

    begin = F.struct(F.struct(start.cast(state).alias("s"), none.alias("out")).cast(inner).alias("now"), F.array().cast(f"array<array<{found}>>").alias("full")).cast(outer)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(parts, begin, block, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["now"]["out"]))))


def carried(df: DataFrame, keys: list[str], order: list[str], start: Column, step: Callable[[Column, Column], tuple[Column, Column]], state: str, found: str) -> DataFrame:
    """df with the fields that a fold finds for each row: one shuffle by keys, no join back.

    The fold goes over a group's rows, structs sorted by `order`; see folded().
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("__rows"))
    zipped = F.arrays_zip("__rows", folded(F.col("__rows"), start, step, state, found).alias("__found"))
    return grouped.select(*keys, F.explode(zipped).alias("__z")).select(*keys, "__z.__rows.*", "__z.__found.*")


def by_page(regions: DataFrame, order: list[str], f: Callable[..., tuple], columns: list[str], schema: str, names: list[str]) -> DataFrame:
    """doc_id, page and what f returns for each page.

    f takes the page's columns as arrays, in the given order of rows, and returns equally long
    sequences for `names`. Pages are dealt by document; a page may straddle Arrow batches.
    """
    every = ["doc_id", "page", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(v: pd.DataFrame) -> pd.DataFrame:
            d, p = v["doc_id"].to_numpy(), v["page"].to_numpy()
            cols = [v[c].to_numpy() for c in columns]
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (p[1:] != p[:-1])) + 1
            docs, pages, parts = [], [], [[] for _ in names]
            for a, b in zip([0, *cuts], [*cuts, len(v)]):  # noqa: B905
                got = f(*[c[a:b] for c in cols])
                for part, values in zip(parts, got, strict=True):
                    part.extend(values)
                docs += [d[a]] * len(got[0])
                pages += [p[a]] * len(got[0])
            return pd.DataFrame({"doc_id": docs, "page": pages} | dict(zip(names, parts, strict=True)))

        for b in batches:
            if not len(b):
                continue
            last = (b["doc_id"] == b["doc_id"].iloc[-1]) & (b["page"] == b["page"].iloc[-1])
            whole = pd.concat([*held, b[~last]], ignore_index=True) if held else b[~last]
            if held and not (~last).any() and (held[-1]["doc_id"].iloc[-1], held[-1]["page"].iloc[-1]) == (b["doc_id"].iloc[-1], b["page"].iloc[-1]):
                held.append(b)
                continue
            if len(whole):
                yield done(whole)
            held = [b[last]]
        if held:
            yield done(pd.concat(held, ignore_index=True))

    dealt = regions.select(*every).repartition("doc_id").sortWithinPartitions("doc_id", "page", *order)
    return dealt.mapInPandas(run, f"doc_id bigint, page int, {schema}")
