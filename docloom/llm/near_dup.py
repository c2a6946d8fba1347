"""MinHash near-dedup: a chosen-path set similarity join.

A document is the set of its word shingles; of the set's minwise hashes, a path chooses some. A
node of a tree is a path: its documents agree in every chosen minwise token. At each node one
token place is chosen, and at the root a second one with such a chance that two documents at the
threshold stay together in one child on average. Nodes of few documents are compared exhaustively.
In a crowded node each document first meets a few pivots, and those that resemble one get its
label; they are connected, so that only documents outside the most common label are still to be
compared. Few of them meet the whole node; if they are many, the node branches again, by two places,
since at one child on average a line dies out sooner or later. Independent trees repeat this, so
that a pair at the threshold is missed by all with a chance below one in a million, in crowded nodes
after all LEVELS choices too. At the last level all that remain outside meet the whole node, in
pairs of blocks, so no node is capped.

Comparisons within a node use eight-bit minwise sketches and name candidates as stars around the
smallest id, never as all pairs. What candidates connect is a group; its full sets are brought
together, and every pair of them is either decided by the exact size of the intersection or
already inside one component. Equal sets share a fingerprint and enter the trees once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import chunks, components, cut, stars

PLACES = 64  # minwise hashes
TREES = 10
NODE = 512  # documents that a node compares exhaustively
FEW = 2048  # documents outside a crowded node's most common label that meet the whole node
BLOCK = 256  # documents of a group whose full sets one task compares with as many others
PIVOTS = 24  # documents of a large group, about, that meet all the others
LEVELS = 3
COLUMNS = 4096  # shingles that an exact comparison takes at once
#: Chance that the sketch filter misses a pair at the threshold.
MISS = 1e-6
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 2**32, PLACES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, PLACES, dtype=np.uint64).astype(np.uint32)


class _Hashes(dict):
    """Word to 64-bit hash; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; ASCII letters lower-cased, words parted by ASCII blanks."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_hashes) > 300_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(n, size)
    acc = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = mix(acc) + h[i : n - k + 1 + i]
    return np.unique(mix(acc))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minwise hash at each place."""
    low = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * _A + _B).min(0), out=low)
    return low


def least_equal(similarity: float) -> int:
    """Fewest equal sketch places of a candidate: a pair at the threshold has fewer with a chance below MISS."""
    missed = 0.0
    for k in range(PLACES + 1):
        missed += comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k)
        if missed > MISS:
            return k
    return PLACES


def paths(minwise: np.ndarray, similarity: float) -> np.ndarray:
    """The first nodes of all trees for one document's minwise hashes."""
    trees = mix(np.arange(1, TREES + 1, dtype=np.uint64))
    first, second, taken = _chosen(trees, similarity)
    return np.concatenate([_child(trees, first, minwise[first]), _child(trees[taken], second[taken], minwise[second[taken]])]).view(np.int64)


def _chosen(path: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each path: the first place, the second one, and whether the second is taken."""
    h = mix(path ^ np.uint64(0x5851F42D4C957F2D))
    first = (h % np.uint64(PLACES)).astype(int)
    second = (first + 1 + ((h >> np.uint64(8)) % np.uint64(PLACES - 1)).astype(int)) % PLACES
    return first, second, (h >> np.uint64(32)).astype(float) / 2**32 < 1 / similarity - 1


def _child(path: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(path * np.uint64(0x2545F4914F6CDD1D) + (token.astype(np.uint64) << np.uint64(8)) + place.astype(np.uint64))


def sketched(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, and of non-empty sets fp, sketch (a byte for each place) and paths, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, rows, nodes = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                low = sketch(s) if len(s) else None
                prints.append(None if low is None else xxhash.xxh3_128_digest(s.tobytes()))
                rows.append(None if low is None else (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
                nodes.append(None if low is None else paths(low, similarity))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(rows, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["doc_id", "mark", "n_shingles", "fp", "sketch", "paths"])

    return docs.select("doc_id", _mark().alias("mark"), F.col("text").cast("binary")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, mark bigint, n_shingles bigint, fp binary, sketch binary, paths array<bigint>")


def children(path: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each twice, and their nodes below crowded nodes, for sketches low."""
    first, second, _ = _chosen(path, 1.0)
    row = np.tile(np.arange(len(path)), 2)
    place = np.concatenate([first, second])
    return row, _child(path[row], place, low[row, place])


def _branches(crowded: DataFrame) -> DataFrame:
    """(node, id, label) of the next level for (node, id, label, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, PLACES)
            path = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row, node = children(path, low)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column(1).take(take), b.column(2).take(take)], names=["node", "id", "label"])

    return crowded.select("node", "id", "label", "sketch").mapInArrow(run, "node bigint, id bigint, label bigint")


def labelled(ids: np.ndarray, low: np.ndarray, pivot: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, list[list[int]]]:
    """Of each document the label of a pivot that it is a candidate of, -1 for none, and further labels that it joins.

    Pivots are few and the same in every block of a node, and so are the labels: the id of the first
    in rank of the pivots that candidates connect. Ranks hold in all nodes, so that labels recur.
    """
    at = np.flatnonzero(pivot)
    at = at[np.argsort(rank[at], kind="stable")]
    near = np.stack([(low == row).sum(1) >= least for row in low[at]], axis=1) if len(at) else np.zeros((len(ids), 0), bool)
    name = np.arange(len(at))
    for a, b in stars(near[at] & ~np.eye(len(at), dtype=bool), name):
        name[b] = a
    name = ids[at][name]
    label, more = np.full(len(ids), -1), [[] for _ in ids]
    if len(at):
        label[near.any(1)] = name[near[near.any(1)].argmax(1)]
    for i in np.flatnonzero(near.sum(1) > 1):
        more[i] = sorted({int(x) for x in name[near[i]] if x != label[i]})
    return label, more


def _met(crowded: DataFrame, least: int) -> DataFrame:
    """(node, id, label, more) for (node, id, label, n, sketch): what each document's look at its node's pivots gives.

    A document that no pivot resembles keeps the label of the node above.
    """
    blocks = F.ceil(F.col("n") / NODE).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    rank = F.xxhash64("id", F.lit("pivot"))
    pivot = F.col("rank") < -(2.0**63) + 2.0**64 * PIVOTS / F.col("n")
    dealt = crowded.withColumn("rank", rank).select("node", "id", "label", "rank", "sketch", own.alias("own"), pivot.alias("pivot"), F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("block"))
    parts = dealt.select(F.xxhash64("node", "block").alias("part"), "node", "id", "label", "rank", "pivot", (F.col("own") == F.col("block")).alias("home"), "sketch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in chunks(batches, "part"):
            ids, pivots, ranks, low = g["id"].to_numpy(), g["pivot"].to_numpy(bool), g["rank"].to_numpy(), np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), PLACES)
            label, more = g["label"].astype("Int64").to_numpy(dtype=np.int64, na_value=-1).copy(), []
            for b, k in zip(*_bounds(g["part"].to_numpy()), strict=True):
                x = slice(b, b + k)
                found, others = labelled(ids[x], low[x], pivots[x], ranks[x], least)
                label[x] = np.where(found < 0, label[x], found)
                more += others
            home = g["home"].to_numpy(bool)
            yield pd.DataFrame({"node": g["node"].to_numpy()[home], "id": ids[home], "label": pd.arrays.IntegerArray(label[home], label[home] < 0), "more": pd.Series(more, dtype=object)[home].to_numpy()})

    return parts.repartition("part").sortWithinPartitions("part").mapInPandas(run, "node bigint, id bigint, label bigint, more array<bigint>")


def _rest_parts(crowded: DataFrame) -> DataFrame:
    """(node, side, id, sketch) of pairs of blocks: a node's documents outside its most common label meet all of it.

    crowded: (node, id, label, n, most, rest, sketch), rest being the number of those outside.
    """
    blocks, rests = F.ceil(F.col("n") / NODE).cast("int"), F.ceil(F.col("rest") / NODE).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    asked = F.pmod(F.xxhash64("id", F.lit("rest")), rests).cast("int")
    meet = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    meets = F.transform(F.sequence(F.lit(0), rests - 1), lambda j: meet(own, j, 1))
    asks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: meet(i, asked, 2))
    outside = ~F.col("label").eqNullSafe(F.col("most")) | F.col("label").isNull()
    dealt = crowded.withColumn("m", F.explode(F.when(outside, F.concat(meets, asks)).otherwise(meets)))
    return dealt.select(F.xxhash64("node", "m.i", "m.j").alias("node"), F.col("m.side").alias("side"), "id", "sketch")


def candidates(sets: DataFrame, least: int) -> list[DataFrame]:
    """Edges (a, b), read from tables already written, that connect all candidates among sets (id, sketch, paths).

    In a crowded node every document meets a few pivots; those that share a label are connected, so
    a node of one label is done, and where few documents remain outside the most common label they
    meet the whole node. Otherwise the node branches. Nodes of one document go before sketches are fetched.
    """
    at = cut(sets.select(F.explode("paths").alias("node"), "id", F.lit(None).cast("bigint").alias("label")))
    sketches = sets.select(F.col("id").alias("of"), "sketch")
    sketched_ = lambda df: df.join(sketches, F.col("id") == F.col("of")).drop("of")
    edges = []
    for level in range(LEVELS):
        told = F.count("label") == F.count("*")
        sizes = cut(at.groupBy("node").agg(F.count("*").alias("n"), (told & (F.min("label") == F.max("label"))).alias("one")).where("n > 1 and not (one <=> true)").select("node", "n"))
        edges.append(cut(_proposed(sketched_(at.join(sizes.where(F.col("n") <= NODE), "node")).select("node", F.lit(0).alias("side"), "id", "sketch"), least)))
        met = cut(_met(sketched_(at.join(sizes.where(F.col("n") > NODE), "node")), least))
        pairs = met.select("id", F.explode(F.array_append(F.coalesce("more", F.array().cast("array<bigint>")), F.col("label"))).alias("y")).where("y is not null and y <> id")
        edges.append(pairs.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")))
        by_label = met.groupBy("node", "label").agg(F.count("*").alias("k"))
        known = F.when(F.col("label").isNotNull(), F.col("k"))
        state = by_label.groupBy("node").agg(F.sum("k").alias("n"), F.max_by("label", F.struct(known, "label")).alias("most"), (F.sum("k") - F.coalesce(F.max(known), F.lit(0))).alias("rest"))
        few = F.lit(level == LEVELS - 1) | (F.col("rest") <= FEW)
        state = cut(state.where("rest > 0").withColumn("few", few))
        kinds = {r.few for r in state.select("few").distinct().collect()}
        left = lambda some: sketched_(met.select("node", "id", "label").join(state.where(some), "node"))  # noqa: E731, B023
        if True in kinds:
            edges.append(cut(_proposed(_rest_parts(left("few")), least)))
        if False not in kinds:
            break
        at = cut(_branches(left("not few")))
    return edges


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return begin, np.diff(np.concatenate([begin, [len(key)]]))


def _proposed(nodes: DataFrame, least: int) -> DataFrame:
    """Candidate edges (a, b), a < b, of nodes (node, side, id, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in chunks(batches, "node"):
            ids, side = g["id"].to_numpy(), g["side"].to_numpy()
            low = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), PLACES)
            begin, size = _bounds(g["node"].to_numpy())
            two = begin[size == 2]  # the most common nodes, all at once
            fit = two[((low[two] == low[two + 1]).sum(1) >= least) & ((side[two] == 0) | (side[two] != side[two + 1]))]
            found = [np.stack([np.minimum(ids[fit], ids[fit + 1]), np.maximum(ids[fit], ids[fit + 1])], axis=1)]
            for b, k in zip(begin[size > 2], size[size > 2], strict=True):
                x = slice(b, b + k)
                linked = np.stack([(low[x] == row).sum(1) >= least for row in low[x]])
                if side[x].any():
                    linked &= side[x][:, None] != side[x]
                np.fill_diagonal(linked, False)
                found.append(np.array(stars(linked, ids[x]), dtype=np.int64).reshape(-1, 2))
            edges = np.unique(np.concatenate(found), axis=0)
            if len(edges):
                yield pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return nodes.repartition("node").sortWithinPartitions("node").mapInPandas(run, "a bigint, b bigint").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.int64)
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, COLUMNS):
        x = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        m = np.zeros((n, min(COLUMNS, last - a)), np.float32)
        m[row[x], column[x] - a] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _sets(docs: DataFrame, grouped: DataFrame, size: int) -> DataFrame:
    """(id, group, n, hashes): the full sets of the members of groups (id, group, doc_id, fp).

    A document's text is found by its id; of repeated ids only texts of the fingerprint count, once in a task.
    """
    sizes = cut(grouped.groupBy("group").agg(F.count("*").alias("n")))
    members = grouped.join(sizes, "group").select("doc_id", "fp", "id", "group", "n")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep, blobs = [], []
            for i, (key, fp, text) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 3, 4)), strict=True)):
                if key in seen:
                    continue
                blob = shingles(text, size).tobytes()
                if xxhash.xxh3_128_digest(blob) == fp:
                    seen.add(key)
                    keep.append(i)
                    blobs.append(blob)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), pa.array(blobs, pa.binary())], names=["id", "group", "n", "hashes"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(members, "doc_id").select("id", "group", "n", "fp", "text").mapInArrow(read, "id bigint, group bigint, n bigint, hashes binary")


def _compared(parts: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is linked among the sets (part, side, id, hashes) of each part.

    side: 0 where all of a part's sets are compared, else 1 and 2, which are compared with each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in chunks(batches, "part"):
            ids, side, blobs = g["id"].to_numpy(), g["side"].to_numpy(), g["hashes"].to_numpy()
            edges: list[tuple[int, int]] = []
            for b, k in zip(*_bounds(g["part"].to_numpy()), strict=True):
                if k < 2:
                    continue
                x = slice(b, b + k)
                own = [np.frombuffer(s, np.uint64) for s in blobs[x]]
                n = np.array([len(s) for s in own])
                both = intersections(own)
                linked = den * both >= num * (n[:, None] + n - both)
                if side[x].any():
                    linked &= side[x][:, None] != side[x]
                np.fill_diagonal(linked, False)
                edges += stars(linked, ids[x])
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    return parts.repartition("part").sortWithinPartitions("part").mapInPandas(run, "a bigint, b bigint")


def _linked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of all pairs at the threshold within each group of (id, group, n, hashes).

    A group of up to BLOCK documents is one part. A larger one is dealt into blocks, and some
    PIVOTS of its documents go to every block: copies of one text are then in one component
    without meeting pairwise. Only documents outside their group's largest component are still
    compared with the whole group, block by block; pairs inside one component need no comparison.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pivot = F.pmod(F.xxhash64("id", F.lit("pivot")), F.ceil(F.col("n") / PIVOTS)) == 0
    places = F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    first = sets.withColumn("block", F.explode(places)).select(F.xxhash64("group", "block").alias("part"), F.lit(0).alias("side"), "id", "hashes")
    links = cut(_compared(first, num, den))
    large, comps = sets.where(F.col("n") > BLOCK), components(links)
    at = cut(large.select("id", "group", "n").join(comps, F.col("id") == F.col("node"), "left").select("id", "group", "n", F.coalesce("component", "id").alias("comp")))
    largest = at.groupBy("group", "comp").agg(F.count("*").alias("k")).groupBy("group").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.sum("k").alias("all"), F.max("k").alias("in"))
    open_ = cut(largest.where(F.col("all") > F.col("in")).select("group", "most", F.ceil((F.col("all") - F.col("in")) / BLOCK).cast("int").alias("rests")))
    if open_.isEmpty():
        return comps
    rest = at.join(open_, "group").select("id", "rests", (F.col("comp") != F.col("most")).alias("rest"))
    left = large.join(rest, "id")
    asked = F.pmod(F.xxhash64("id", F.lit("rest")), F.col("rests")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    asks = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("i"), asked.alias("j"), F.lit(2).alias("side")))
    second = left.withColumn("m", F.explode(F.when(F.col("rest"), F.concat(meets, asks)).otherwise(meets))).select(F.xxhash64("group", "m.i", "m.j").alias("part"), F.col("m.side").alias("side"), "id", "hashes")
    return components(links.unionByName(_compared(second, num, den)))


def _components(docs: DataFrame, reps: DataFrame, first: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, component) of the linked ones among reps (id, sketch, paths), one for each distinct set."""
    found = candidates(cut(reps), least_equal(num / den))
    groups = components(reduce(DataFrame.unionByName, found))
    grouped = groups.select(F.col("node").alias("id"), F.col("component").alias("group")).join(first.select("id", "doc_id", "fp"), "id")
    return _linked(cut(_sets(docs, grouped, size)), num, den)


def _decided(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id for every row of docs."""
    every = cut(sketched(docs, size, num / den))
    some = every.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    # sets are numbered, so that ids of any type will do
    first = cut(some.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    reps = some.join(first.select("fp", "doc_id", "id"), ["fp", "doc_id"]).dropDuplicates(["fp", "doc_id"]).select("id", "sketch", "paths")
    comps = cut(_components(docs, reps, first, size, num, den).join(first.select(F.col("id").alias("node"), "doc_id", "fp"), "node"))
    names = comps.groupBy("component").agg(F.min("doc_id").alias("name"))
    alone = first.where("n > 1").join(comps.select("fp"), "fp", "left_anti").select("fp", F.col("doc_id").alias("name"))
    named = cut(comps.join(names, "component").select("fp", "name").unionByName(alone))
    out = every.select("doc_id", "mark", "n_shingles", "fp").join(named, "fp", "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text); ids of any type that has an order.

    Sets with den * intersection >= num * union are linked; a component is named by its smallest
    id, whose document is kept. A text without words, or a null one, has an empty set and is its
    own component. Equal texts fall together whatever their number; an empty table gives no rows;
    other columns are not read. A null id is left alone, with a null component, and kept. Rows of
    one id are each judged by their own text: `kept` says that the component bears the row's id.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _decided(docs, size, num, den).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def representatives(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, that deduplicate() keeps; of rows equal in id and text one stays.

    Rows with a null id, and texts without words under ids of their own, stay. No rows give none.
    """
    said = cut(_decided(docs, size, num, den).where(F.col("doc_id").isNotNull()))
    gone = said.where("doc_id <> component_id").select("doc_id", "mark").distinct()
    marked = docs.withColumn("__mark", _mark())
    match = lambda other: marked["doc_id"].eqNullSafe(other["doc_id"]) & (marked["__mark"] == other["mark"])
    kept = marked.join(gone, match(gone), "left_anti")
    twice = cut(said.groupBy("doc_id", "mark").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "mark"))
    if not twice.isEmpty():
        on = kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept["__mark"] == twice["mark"])
        kept = kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "__mark"]))
    return kept.select(*docs.columns)


def _mark() -> Column:
    """A hash of the text; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
