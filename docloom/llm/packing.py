"""Best-fit packing under conflicts.

Texts become pieces of at most `capacity` words; pieces go to bins, largest first. Bins are kept
in the order of their residual room, and each carries a bitmap of its sources and one of its
duplicate clusters. The search starts at the tightest bin with room and goes on to its successors
until one is compatible: a bin takes no second piece of a duplicate cluster and at most
`per_source` of a source.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import groups

CAPACITY = 2048
#: Pieces of one source that a bin may hold: the bitmap has so many bits for each source.
PER_SOURCE = 4
#: Documents are packed in shards of about so many, dealt by a hash of their ids.
SHARD = 2048
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, place of the first word) of each piece, in the given order of pieces."""
    bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    number_s, number_c = {}, {}
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        low = per_source * number_s.setdefault(source, len(number_s))
        full = ((1 << per_source) - 1) << low
        c = 1 << number_c.setdefault(cluster, len(number_c)) if cluster is not None else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            b = bins[at][1]
            if source_bits[b] & full != full and not cluster_bits[b] & c:
                break
            at += 1
        if at < len(bins):
            room, b = bins.pop(at)
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        placed.append((b, capacity - room))
        free = ~source_bits[b] & full
        source_bits[b] |= free & -free  # the source's lowest free bit
        cluster_bits[b] |= c
        if room > size:
            insort(bins, (room - size, b))
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin, bin_start: where every word of every text goes.

    A text of more than `capacity` words is cut into whole pieces and a rest, all of them packed.
    A null or empty text has no words and takes no room: it keeps one row with piece 0, no words
    and no bin. A null source is a source of its own. The texts' exact copies (by hash) are a
    duplicate cluster. Repeated rows are packed each by itself; an empty table gives no rows; other
    columns are not read. Shards are as many as the documents ask for; only ids, sizes and hashes
    are shuffled, so a hot source or cluster is spread over all shards. bin is shard and number.
    """
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.count()
    shards = max(1, -(-rows // shard))
    sized = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), F.xxhash64("text").alias("cluster"))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "shard"):
            yield _packed(g, capacity, per_source)

    kind = dict(docs.dtypes)["doc_id"]
    placed = dealt.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, "doc_id string, piece bigint, first_word bigint, n_words bigint, bin string, bin_start bigint")
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind))


def _packed(g: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    size = g["size"].to_numpy()
    pieces = np.maximum(1, -(-size // capacity))
    row = np.repeat(np.arange(len(g)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    words = np.minimum(capacity, size[row] - piece * capacity)
    ids = g["doc_id"].to_numpy()[row]
    cluster = g["cluster"].to_numpy()
    source = g["source"].astype(object).where(g["source"].notna(), None).to_numpy()
    order = np.lexsort((piece, cluster[row], pd.Series(ids).rank(method="dense", na_option="top").to_numpy(), -words))
    order = order[words[order] > 0]
    # whole pieces of one text differ from each other, so a cluster is a text's piece
    marks = [(cluster[row[i]], piece[i]) for i in order]
    placed = best_fit(words[order].tolist(), [source[row[i]] for i in order], marks, capacity, per_source)
    bins, start = np.full(len(row), None, dtype=object), pd.array([pd.NA] * len(row), dtype="Int64")
    name = int(g["shard"].iloc[0])
    for i, (b, at) in zip(order, placed, strict=True):
        bins[i], start[i] = f"{name}-{b}", at
    return pd.DataFrame({"doc_id": ids, "piece": piece, "first_word": piece * capacity, "n_words": words, "bin": bins, "bin_start": start})
