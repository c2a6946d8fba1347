"""What the corpus operators share: reading tables, grouped streams, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import settled as cut

#: Texts reach Python in Arrow batches of so many rows; very long texts keep a batch within a few dozen MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by a path that only Spark needs to understand."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def groups(batches: Iterator[pd.DataFrame], key: str, least: int = 1) -> Iterator[pd.DataFrame]:
    """Whole groups of at least `least` rows from a stream of batches sorted by `key`.

    A group may straddle batches; at most one group and one batch are held.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1][key].iloc[-1] != k[0]:
            cuts = np.concatenate([[0], cuts])
        if not len(cuts):
            held.append(batch)
            continue
        first = pd.concat([*held, batch.iloc[: cuts[0]]], ignore_index=True)
        if len(first) >= max(1, least):
            yield first
        sizes = np.diff(cuts)
        for i in np.flatnonzero(sizes >= least):
            yield batch.iloc[cuts[i] : cuts[i + 1]]
        held = [batch.iloc[cuts[-1] :]]
    if held:
        last = pd.concat(held, ignore_index=True)
        if len(last) >= max(1, least):
            yield last


def chunks(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The same rows, cut so that no group of a stream sorted by `key` is parted."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        if held and held[-1][key].iloc[-1] != k[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = int(np.searchsorted(k, k[-1]))
        if last:
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def stars(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the smallest id of each component of a symmetric matrix to its other members."""
    seen, edges = ~linked.any(1), []
    for start in np.argsort(ids, kind="stable").tolist():
        if seen[start]:
            continue
        seen[start] = True
        wave = np.array([start])
        while len(wave):
            wave = np.flatnonzero(linked[wave].any(0) & ~seen)
            seen[wave] = True
            edges += [(int(ids[start]), int(ids[k])) for k in wave if ids[k] != ids[start]]
    return edges


#: Edges, about, that one task connects on its own: some dozen MB.
EDGES = 200_000


def _connected(edges: DataFrame, tasks: int) -> DataFrame:
    """(node, label): what the edges (a, b) within each of so many tasks connect, named by its smallest node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for g in batches:
            for a, b in zip(g["a"].tolist(), g["b"].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        for i in range(0, len(nodes), 10_000):
            yield pd.DataFrame({"node": nodes[i : i + 10_000], "label": [root(x) for x in nodes[i : i + 10_000]]})

    return edges.coalesce(tasks).mapInPandas(run, "node bigint, label bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of an edge (a, b) reaches.

    Tasks of a bounded number of edges connect what they hold; if there are several, what they found
    are edges again. On those, minimum labels travel along the edges, and from each node's label to
    the node, so that the rounds grow with the logarithm of a component's width. Aggregations
    combine on the map side; each join reads two tables already written, so that adaptive
    execution can split a hub's rows.
    """
    edges = cut(edges.select("a", "b").distinct())
    tasks = max(1, -(-edges.count() // EDGES))
    forest = cut(_connected(edges, tasks))
    if edges.coalesce(tasks).rdd.getNumPartitions() <= 1:
        return forest.select("node", F.col("label").alias("component"))
    own = F.struct(F.col("node").alias("a"), F.col("label").alias("b"))
    both = cut(forest.select(F.explode(F.array(own, F.struct(F.col("label").alias("a"), F.col("node").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    state = None
    while True:
        ways = both.unionByName(labels.where("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b")))
        at = labels.select(F.col("node").alias("at"), "label")
        heard = ways.join(at, ways.a == at["at"]).select(F.col("b").alias("node"), "label")
        labels = cut(heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if now == state:
            return labels.select("node", F.col("label").alias("component"))
        state = now
