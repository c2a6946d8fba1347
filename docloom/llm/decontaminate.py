"""Benchmark decontamination: Wu-Manber multi-pattern search over word symbols.

A benchmark item of n words gives the patterns of `window` consecutive words (one shorter pattern
if it has fewer). Texts and patterns are sequences of word numbers. The shift table of two-word
blocks says how far the search window may jump; where it says 0, the bucket of that suffix block
holds the patterns, and a direct comparison of all their words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII letters are lower-cased; every other ASCII byte but digits parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
#: Items are sent to the workers in shards of at most so many characters.
SHARD_CHARS = 16_000_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Searches all windows of the items in one document at a time."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        owners: dict[bytes, str | set[str]] = {}  # most windows have one owner
        for item, text in items:
            ids = np.array([number(w, len(self.vocabulary)) for w in words(text)], np.int32)
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                p = ids[i : i + m].tobytes()
                held = owners.setdefault(p, item)
                if held != item:
                    owners[p] = {*held, item} if isinstance(held, set) else {held, item}
        self.classes = [self._tables(m, {p: o for p, o in owners.items() if len(p) == 4 * m}) for m in sorted({len(p) // 4 for p in owners})]

    @staticmethod
    def _tables(m: int, patterns: dict[bytes, str | set[str]]):
        """Shifts and buckets; a block of two word numbers is one key, and a bucket holds its patterns as bytes."""
        shift: dict[int, int] = {}
        buckets: dict[int, dict[bytes, str | set[str]]] = {}
        for p, items in patterns.items():
            w = np.frombuffer(p, np.int32).tolist()
            for j in range(1, m):
                block = w[j - 1] << 32 | w[j]
                shift[block] = min(shift.get(block, m - 1), m - 1 - j)
            buckets.setdefault(w[max(0, m - 2)] << 32 | w[m - 1], {})[p] = items
        return m, shift, buckets

    def search(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, disjoint hit ranges of words, items that occur."""
        tokens = words(text)
        get, n = self.vocabulary.get, len(tokens)
        ids = np.array([get(w, -1) for w in tokens], np.int32)
        listed, raw = ids.tolist(), ids.tobytes()
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for m, shift, buckets in self.classes:
            i, most, jump = m - 1, m - 1, shift.get
            while i < n:
                a, b = listed[i - 1 if m > 1 else i], listed[i]
                block = a << 32 | b if a >= 0 and b >= 0 else -1
                s = jump(block, most) if m > 1 else 0
                if s:
                    i += s
                    continue
                begin = i - m + 1
                bucket = buckets.get(block)
                owner = bucket.get(raw[4 * begin : 4 * i + 4]) if bucket else None
                if owner is not None:
                    found.append((begin, i + 1))
                    items |= owner if isinstance(owner, set) else {owner}
                i += 1
        return n, merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[str, WuManber] = {}


def _shards(benchmark: DataFrame, shard_chars: int) -> Iterator[list[tuple[str, bytes]]]:
    """The usable items, in lists of about shard_chars characters at most."""
    b = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    shards = -(-(b.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars) or 1
    for i in range(shards):
        shard = b if shards == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == i)
        yield [(r.item, bytes(r.text)) for r in shard.collect()]


def _machine(docs: DataFrame, items: list[tuple[str, bytes]], window: int):
    """A function that gives the items' tables, built once in a worker."""
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def machine() -> WuManber:
        if key not in _built:
            _built.clear()
            _built[key] = WuManber(sent.value, window)
        return _built[key]

    return machine


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs; no shuffle."""
    at, out = docs.columns.index("text"), docs
    for items in _shards(benchmark, shard_chars):
        get = _machine(docs, items, window)

        def run(batches: Iterator[pa.RecordBatch], get=get) -> Iterator[pa.RecordBatch]:
            machine = get()
            for b in batches:
                yield b.filter(pa.array([not machine.search(t)[1] for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """docs(doc_id, text, n_words, spans, items) with what these items add."""
    get = _machine(docs, items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = get()
        for b in batches:
            n, spans, names = [], [], []
            for text, held, known in zip(*(b.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                k, found, items = machine.search(text)
                n.append(k)
                spans.append([{"begin": x, "end": y} for x, y in merged([*found, *((h["begin"], h["end"]) for h in held)])])
                names.append(sorted(items.union(known)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, docs.schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, n_words, spans (disjoint hit ranges of words), items (ids that occur, sorted) of each row of docs.

    The benchmark's size is summed first. Up to shard_chars it goes to the workers whole and the
    documents are read once without a shuffle; a larger one is dealt into shards by a hash of the
    item, searched one after the other in the same pass, and the ranges are united row by row.

    A null or empty text has no words and no spans; items without an id or words are left out;
    repeated items count once by id; repeated documents and those without an id are rows of their own,
    however many shards there are. Empty tables give no rows or no hits. Other columns are not read.
    """
    out = docs.select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for items in _shards(benchmark, shard_chars):
        out = _scan(out, items, window)
    return out.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the checksum of overlaps()."""
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"])
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Words, hit words and items of one text, by comparing every position with every window."""
    split = lambda t: words(t.encode() if t else None)
    doc, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for j in range(len(doc) - len(p) + 1):
                if doc[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(item)
    return len(doc), len(hit), sorted(found)


def checksum(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
