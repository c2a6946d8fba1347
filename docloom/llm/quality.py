"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A labelled good document is preferred to a labelled bad one. The weights w minimise the logistic
loss log(1 + exp(-w . (x_good - x_bad))), meant over all pairs of a good and a bad training document;
w . x ranks documents. The score quantile at which as many training documents lie below as are
labelled bad is the threshold, and the published score is the logistic function of the distance to it.

No pair is formed. A document's part of the gradient is a smooth function of its score, the sum of
logistic curves about all scores of the other side. So each pass sums powers of the scores' distances
from the centres of narrow bins, the series of the curves about these centres turn them into one
short polynomial for each bin, and each document reads its sum over all partners from that. Passes
run over a table of all training documents' features; only sums by bin reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut

#: Width of a bin of scores, and terms of the series about its centre: (WIDTH / 2 / pi) ** TERMS, what is left out, is 1e-10.
WIDTH, TERMS = 1 / 16, 5
#: Sums are of whole multiples of it in 64 bits, for up to some 2 ** 30 rows: so they are the same in any order.
GRAIN = 2.0**-28
#: Rows that are summed at a time, and, about, by one task.
ROWS, TASK_ROWS = 4096, 65_536
RIDGE = 1e-3

SYMBOLS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:'\"()-?" and not chr(c).isalnum())
UPPERS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
FEATURES = (
    "log_words", "symbols", "symbol_words", "pipes", "uppers", "upper_words", "digits", "same_as_last", "distinct", "top_word",
    "word_length", "long_words", "repeated_lines", "line_words", "stops", "commas", "run_on", "alphabetic",
)


def features(text: bytes | None) -> list[float]:
    """What a text's form says, from all of its bytes; all zeros for none."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(text), len(words)
    gone = lambda drop: size - len(text.translate(None, drop))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(kinds)
    chars = sum(map(len, words))
    enders = sum(k for w, k in kinds.items() if w[-1:] in b".!?")
    return [
        float(np.log1p(n)),
        min(1.0, 4 * gone(SYMBOLS) / size),
        sum(k for w, k in kinds.items() if w[-1] in SYMBOLS) / n,
        min(1.0, 4 * text.count(b"|") / n),
        min(1.0, 2 * gone(UPPERS) / size),
        sum(k for w, k in kinds.items() if len(w) > 1 and w.isupper()) / n,
        min(1.0, 4 * gone(DIGITS) / size),
        sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
        (distinct / n) * float(np.log1p(n)) / 7,
        max(kinds.values()) / n,
        min(1.0, chars / n / 20),
        sum(k for w, k in kinds.items() if len(w) > 24) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 100),
        min(1.0, 2 * enders / n),
        min(1.0, 2 * text.count(b",") / n),
        min(1.0, max(map(len, kinds)) / 100),
        sum(k for w, k in kinds.items() if w[:1].isalpha() or w[0] > 127) / n,
    ]


@dataclass(frozen=True)
class Ranker:
    """Weights over standardised features, and the threshold on w . x."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their rows of whole numbers."""
    order = np.argsort(keys, kind="stable")
    some, first = np.unique(keys[order], return_index=True)
    return some, np.add.reduceat(values[order], first, axis=0) if len(keys) else values


def _grains(values: np.ndarray) -> np.ndarray:
    return np.rint(values / GRAIN).astype(np.int64)


def _placed(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised features, the bin of the score, and the powers of its distance from the bin's centre."""
    z = (x - mean) / scale
    s = (z * w).sum(1)  # row by row, whatever the rows beside it
    at = np.floor(s / WIDTH).astype(np.int64)
    return z, at, (s - (at + 0.5) * WIDTH)[:, None] ** np.arange(TERMS)


def _curves(v: np.ndarray) -> Iterator[np.ndarray]:
    """log(1 + exp(v)) and its derivatives, as many as two series need."""
    yield np.logaddexp(0, v)
    p = 1 / (1 + np.exp(-np.clip(v, -700, 700)))
    terms = np.polynomial.Polynomial([0, 1])
    for _ in range(2 * TERMS - 1):
        yield terms(p)
        terms = terms.deriv() * np.polynomial.Polynomial([0, 1, -1])


def _paired(keys: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss over all pairs; for each bin the polynomial of the mean chance that a pair with a
    document there is put wrong; and the part of the loss's curvature that two documents share.

    keys are 2 * bin + label, sums of powers and features by bin.
    """
    good = keys % 2 == 1
    centre = (keys // 2 + 0.5) * WIDTH
    mass = sums[:, :TERMS] / np.array([factorial(k) for k in range(TERMS)])  # by the factorials of the series
    up, down = mass[good] / mass[good, 0].sum(), mass[~good] / mass[~good, 0].sum()
    z_up, z_down = sums[good, TERMS:] / mass[good, 0].sum(), sums[~good, TERMS:] / mass[~good, 0].sum()
    turn = (-1.0) ** np.arange(TERMS)
    loss, shared = 0.0, np.zeros((z_up.shape[1],) * 2)
    chance_up, chance_down = np.zeros(up.shape), np.zeros(down.shape)
    for i in range(0, len(down), 256):
        rows = slice(i, i + 256)
        for n, curve in enumerate(_curves(centre[~good][rows, None] - centre[good][None])):
            for k in range(max(0, n - TERMS + 1), min(n, TERMS - 1) + 1):  # powers of the bad one, the rest of the good one
                loss += down[rows, k] @ curve @ up[:, n - k] * turn[n - k]
            for k in range(max(0, n - TERMS), min(n - 1, TERMS - 1) + 1):
                rest = n - 1 - k
                chance_up[:, k] += turn[k] / factorial(k) * (curve.T @ down[rows, rest])
                chance_down[rows, k] += 1 / factorial(k) * (curve @ (turn[rest] * up[:, rest]))
            if n == 2:
                shared += z_up.T @ (curve.T @ z_down[rows])
    chance = np.zeros((len(keys), TERMS))
    chance[good], chance[~good] = chance_up, chance_down
    return float(loss), chance, shared + shared.T


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles of these bits, and back."""
    return bits ^ ((bits >> 63) & 0x7FFF_FFFF_FFFF_FFFF)


def _at_place(total: Callable, score: Callable, place: int) -> float:
    """The score at this place of all in order: four passes count it down by 16 bits each, whatever scores are equal."""
    found, left = 0, place
    for shift in (48, 32, 16, 0):

        def counted(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = _ordered(score(x).view(np.int64))
            keys = keys[keys >> shift + 16 == found] if shift < 48 else keys  # noqa: B023
            return keys >> shift, _grains(np.ones((len(keys), 1)))  # noqa: B023

        keys, counts = total(counted)
        upto = np.cumsum(counts[:, 0])
        k = int(np.searchsorted(upto, left, "right"))
        found, left = int(keys[k]), left - (upto[k - 1] if k else 0)
    return float(_ordered(np.array([found])).view(np.float64)[0])


def _learn(total: Callable) -> Ranker:
    """A ranker from total(f), the sums of f(x, good) by key over all training rows.

    Without both labels it gives every text 0.5.
    """
    d = len(FEATURES)
    keys, sums = total(lambda x, good: (good, _grains(np.concatenate([np.ones((len(x), 1)), x], axis=1))))
    if len(keys) < 2:
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    bad_rows, good_rows = sums[:, 0]
    n = int(bad_rows + good_rows)
    mean = sums[:, 1:].sum(0) / n
    scale = np.ones(d)
    for _ in range(2):  # once more, so that the grain is small beside it
        spread = np.sqrt(total(lambda x, good: (0 * good, _grains(((x - mean) / scale) ** 2)))[1][0] / n)  # noqa: B023
        scale = scale * np.where(spread < 1e-9, 1.0, spread)

    def bins(x: np.ndarray, good: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, at, powers = _placed(x, mean, scale, w)
        return 2 * at + good, _grains(np.concatenate([powers, z], axis=1))

    a, b = np.triu_indices(d)

    def slopes(x: np.ndarray, good: np.ndarray, w: np.ndarray, keys: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, at, powers = _placed(x, mean, scale, w)
        own, sign = chance[np.searchsorted(keys, 2 * at + good)], np.where(good == 1, -1.0, 1.0)
        pull = sign * (own * powers).sum(1)
        bend = sign * (own[:, 1:] * np.arange(1, TERMS) * powers[:, :-1]).sum(1)
        return good, _grains(np.concatenate([pull[:, None] * z, bend[:, None] * z[:, a] * z[:, b]], axis=1))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        keys, sums = total(lambda x, good: bins(x, good, w))
        loss, chance, shared = _paired(keys, sums)
        return loss + RIDGE / 2 * float(w @ w), keys, chance, shared

    w = np.zeros(d)
    loss, keys, chance, shared = at(w)
    for _ in range(30):  # Newton's steps, halved while the loss grows
        by_label = total(lambda x, good: slopes(x, good, w, keys, chance))[1]  # noqa: B023
        each = by_label[0] / bad_rows + by_label[1] / good_rows
        curve = np.zeros((d, d))
        curve[a, b] = curve[b, a] = each[d:]
        step = np.linalg.solve(curve - shared + RIDGE * np.eye(d), each[:d] + RIDGE * w)
        while True:
            now, *rest = at(w - step)
            if now <= loss + 1e-9 or np.abs(step).max() < 1e-7:
                break
            step = step / 2
        w, loss, (keys, chance, shared) = w - step, now, rest
        if np.abs(step).max() < 1e-7:
            break
    place = bad_rows / n * (n - 1)
    low, high = (_at_place(total, lambda x: (((x - mean) / scale) * w).sum(1), p) for p in (int(place), min(int(place) + 1, n - 1)))
    return Ranker(mean, scale, w, low + (place - int(place)) * (high - low))


def learn(x: np.ndarray, good: np.ndarray) -> Ranker:
    """A ranker from features and labels (0 or 1) at hand."""

    def total(f: Callable) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = _summed(*f(x, good.astype(np.int64)))
        return keys, sums * GRAIN

    return _learn(total)


def fold(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the features, as bytes, of every row of docs: some 150 bytes a row, in the shared folder."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([np.array(features(t)).tobytes() for t in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], x], names=[*keep, "x"])

    return cut(docs.select(F.col("text").cast("binary").alias("text"), *keep).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["x binary"])))


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=float).reshape(len(blobs), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learn from all labelled documents whose fold is not 1.

    Rows of labels without an id or a quality of 0 or 1 are left out; of repeated ids every row counts.
    """
    return _trained(_measured(docs.where(fold() != 1), "doc_id"), labels)


def _trained(measured: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from _measured rows with doc_id. Their features meet the labels, not their texts."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold() != 1)).select("doc_id", F.col("quality").cast("bigint").alias("good"))
    known = cut(measured.join(usable, "doc_id").select("good", "x"))
    known = known.coalesce(max(1, -(-known.count() // TASK_ROWS)))

    def total(f: Callable) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, held = [], []

            def take() -> None:
                found = _summed(*f(np.concatenate([_matrix(b.column(1)) for b in held]), np.concatenate([b.column(0).to_numpy() for b in held])))
                parts[:] = [_summed(*map(np.concatenate, zip(*parts, found, strict=True)))]
                held.clear()

            for b in batches:
                if b.num_rows:
                    held.append(b)
                if sum(h.num_rows for h in held) >= ROWS:
                    take()
            if held:
                take()
            for keys, sums in (p for p in parts if len(p[0])):
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["keys", "sums"])

        found = known.mapInArrow(run, "keys binary, sums binary").collect()
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, 1))
        keys = [np.frombuffer(r[0], np.int64) for r in found]
        sums = [np.frombuffer(r[1], np.int64).reshape(len(k), -1) for r, k in zip(found, keys, strict=True)]
        some, whole = _summed(np.concatenate(keys), np.concatenate(sums))
        return some, whole * GRAIN

    return _learn(total)


def accepted(docs: DataFrame, ranker: Ranker, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(at).cast(pa.binary()).to_pylist()], dtype=float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(ranker.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    Scores are numbers from 0 to 1 for null and empty texts too; repeated rows are scored each by
    itself; an empty table gives no rows; without labels of both kinds every score is 0.5. A null
    id is in no fold. Only the text enters a score. Each text is measured once, to learn and to score.
    """
    kind = dict(docs.dtypes)["doc_id"]
    measured = _measured(docs, "doc_id")
    ranker = _trained(measured, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranker.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    out = measured.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
