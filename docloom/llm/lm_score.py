"""Language-model scoring by logistic context mixing.

A token is coded by up to three binary decisions: is it the candidate of the hashed order-2 context,
the one that followed the last word before in the same text, the candidate of the hashed order-1
context? Each decision's bit is predicted by several contexts: the counts behind the hashed
contexts, whether candidates agree, which decisions met the last tokens, the place in the text. Their
stretched probabilities are combined by weights that a gate (the decision and its candidate's count)
selects, refined block by block while a text is read. With p of each decision and the unigram share
U, P(w) = p1 [w = c1] + (1 - p1) (p2 [w = c2] + (1 - p2) (p3 [w = c3] + (1 - p3) U(w))), whose
sum over all tokens is 1.

What training gathers grows with the corpus: the counts of all tokens and of all successors of
all order-1 and order-2 contexts, exact sums over every training text. Texts become portions of
bounded size; a portion sends its distinct (context, successor) pairs to ranges of the contexts'
hashes, where all portions' counts meet, and gets back each pair's candidate. A training text's own
occurrence is left out of the counts that judge it. Predictors and weights are fitted on the counts
of a fixed number of decision states, again summed over all training texts, so that no result
depends on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut
from docloom.llm.near_dup import mix
from docloom.llm.quality import fold

#: Bytes of text in a portion; a longer text is a portion of its own.
PORTION = 4_000_000
#: Portions for each range of context hashes: what one task holds stays the same at every size.
PORTIONS_A_RANGE = 2
DECISIONS = 3
#: A context's state: none, or its candidate's count (1, 2, 3-4, 5-8, 9 on) by its share of the context (4 classes).
STATES = 24
AGREE, PAST, OLDER, PLACES = 16, 4, 2, 4
JOINT = STATES * STATES * AGREE * PAST * OLDER * PLACES
PREDICTORS = 5
INPUTS = PREDICTORS + 1
GATES = DECISIONS * 6
BLOCK = 128  # tokens after which a text's weights are refined
RATE = 0.02
END, BEGIN = -1, -2
TOKEN = 16  # bits of a successor's hash
COUNTS, FIRST, SECOND = range(3)  # what a range is asked for


class Lexicon(dict):
    """Words seen by this worker, numbered, and their hashes. END is number 0."""

    def __init__(self):
        super().__init__()
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self[None] = 0
        self.fresh, self.hash = [END], np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(word) >> 1)
        return k

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, each text closed by END, and how many each text has."""
        if len(self) > 400_000:
            self.clear_all()
        parts, sizes = [], np.empty(len(texts), np.int64)
        get, end = self.__getitem__, np.zeros(1, np.int32)
        for i, t in enumerate(texts):
            words = t.lower().split() if t else []
            parts += (np.fromiter(map(get, words), dtype=np.int32, count=len(words)), end)
            sizes[i] = len(words) + 1
        self.hash = np.concatenate([self.hash, np.array(self.fresh, np.int64)])
        self.fresh = []
        return np.concatenate(parts), sizes


def packed(x: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw, width = zstandard.ZstdDecompressor().decompress(blob), np.dtype(kind).itemsize
    if not raw:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def before(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[starts] = BEGIN
    return out


def contexts(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The last token, the one before, and the hashes of the order-1 and order-2 contexts."""
    starts = np.cumsum(sizes) - sizes
    one = before(h, starts)
    two = before(one, starts)
    first = mix(one.view(np.uint64))
    return one, two, first, mix(first + two.view(np.uint64) * np.uint64(0xD1342543DE82EF95))


def pairs(context: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """`width` bits of the context before TOKEN bits of its successor."""
    return (context >> np.uint64(64 - width) << np.uint64(TOKEN)) | ((h.view(np.uint64) >> np.uint64(20)) & np.uint64((1 << TOKEN) - 1))


def ranges(key: np.ndarray, count: int, kind: int, width: int) -> np.ndarray:
    """Where each of `count` ranges begins in sorted keys, and the end."""
    low, width = (24, 40) if kind == COUNTS else (TOKEN, width)
    return np.searchsorted(key >> np.uint64(low), (np.arange(count + 1, dtype=np.uint64) << np.uint64(width)) // np.uint64(count))


@dataclass
class Portion:
    """Tokens of some texts by their number in the portion's own vocabulary of hashes."""

    sizes: np.ndarray
    tokens: np.ndarray
    vocabulary: np.ndarray
    train: np.ndarray  # a flag for each text

    def __post_init__(self):
        self.h = self.vocabulary[self.tokens]
        self.training = np.repeat(self.train, self.sizes)

    def asked(self, kind: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the training tokens and of the others: distinct keys, sorted, which of them each token has, and how often each occurs."""
        if kind == COUNTS:
            key = mix(self.vocabulary.view(np.uint64))
            order = np.argsort(key)
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            return [(key[order], at, np.bincount(self.tokens[self.training], minlength=len(order))[order])]
        _, _, first, second = contexts(self.h, self.sizes)
        key = pairs(first if kind == FIRST else second, self.h, width)
        return [np.unique(key[m], return_inverse=True, return_counts=True) for m in (self.training, ~self.training)]


PORTIONS = "portion bigint, ids array<{kind}>, held array<boolean>, n_bytes array<bigint>, sizes binary, tokens binary, vocabulary binary"


def _portions(docs: DataFrame, most: int) -> DataFrame:
    """The texts of docs(doc_id, held, text) in portions."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Lexicon(), TaskContext.get().partitionId() << 33
        ids, held, texts, size, id_type = [], [], [], 0, None

        def portion() -> pa.RecordBatch:
            tokens, sizes = words.read(texts)
            used, own = np.unique(tokens, return_inverse=True)
            blobs = [packed(sizes), packed(own.astype(np.int32)), packed(words.hash[used])]
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t or b"") for t in texts]], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs)]
            return pa.RecordBatch.from_arrays(columns, names=["portion", "ids", "held", "n_bytes", "sizes", "tokens", "vocabulary"])

        for b in batches:
            id_type = b.column(0).type
            for i, out, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if texts and size + len(t or b"") > most:
                    yield portion()
                    number, ids, held, texts, size = number + 1, [], [], [], 0
                ids.append(i)
                held.append(out)
                texts.append(t)
                size += len(t or b"") + 8
        if texts:
            yield portion()

    return docs.mapInArrow(run, PORTIONS.format(kind=kind.simpleString()))


def _each(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def _portion(row: dict) -> Portion:
    return Portion(unpacked(row["sizes"], np.int64), unpacked(row["tokens"], np.int32), unpacked(row["vocabulary"], np.int64), ~np.array(row["held"], bool))


def _asked(portions: DataFrame, count: int, width: int) -> DataFrame:
    """(key, kind, portion, train, times, others): what portions ask of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _each(b):
                p = _portion(row)
                for kind in (COUNTS, FIRST, SECOND):
                    sets = p.asked(kind, width)
                    cuts = [ranges(s[0], count, kind, width) for s in sets]
                    out = []
                    for r in range(count):
                        (a, z), (c, y) = (c[r : r + 2] for c in (cuts[0], cuts[-1]))
                        others = sets[1][0][c:y] if len(sets) > 1 else np.zeros(0, np.uint64)
                        if z > a or len(others):
                            out.append((r * 3 + kind, kind, row["portion"], packed(np.diff(sets[0][0][a:z], prepend=np.uint64(0))), packed(sets[0][2][a:z]), packed(np.diff(others, prepend=np.uint64(0)))))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["key", "kind", "portion", "train", "times", "others"])

    return portions.select("portion", "held", "sizes", "tokens", "vocabulary").mapInArrow(run, "key bigint, kind int, portion bigint, train binary, times binary, others binary")


def state(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The candidate's count by its share of the context; 0 to 3 stand for none."""
    share = most / np.maximum(total, 1)
    return (np.searchsorted([1, 2, 3, 5, 9], most, side="right") * 4 + np.searchsorted([0.25, 0.6, 0.95], share, side="right")).astype(np.uint8)


def candidates(train: np.ndarray, times: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each training pair and each other one: hit, state and 8 bits of the candidate, given all training pairs of a range.

    The candidate is the most frequent successor, of equals the one of greatest hash; one
    occurrence of a training pair is left out of the counts that it meets.
    """
    pair, own = np.unique(train, return_inverse=True)
    n = np.bincount(own, times, len(pair)).astype(np.int64)
    context = pair >> np.uint64(TOKEN)
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(pair) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(pair)]]))
    group = np.repeat(np.arange(len(begin)), size)
    total = np.bincount(group, n, len(begin)).astype(np.int64)
    order = np.lexsort((n, group))
    best = order[begin + size - 1] if len(begin) else begin
    next_ = np.where(size > 1, order[np.maximum(begin + size - 2, 0)], -1) if len(begin) else begin
    g = group[own]
    first, second = best[g], next_[g]
    is_first = own == first
    left = n[first] - is_first
    other = np.where(second >= 0, n[second], 0)
    turned = is_first & ((other > left) | ((other == left) & (second > first)))
    cand, most = np.where(turned, second, first), np.where(turned, other, left)
    place = np.searchsorted(context[begin], others >> np.uint64(TOKEN)) if len(begin) else np.zeros(len(others), np.int64)
    place = np.minimum(place, max(0, len(begin) - 1))
    known = context[begin][place] == others >> np.uint64(TOKEN) if len(begin) else np.zeros(len(others), bool)
    at = best[place] if len(begin) else place
    cand = np.concatenate([cand, at]).astype(np.int64)
    most = np.concatenate([most, np.where(known, n[at] if len(begin) else 0, 0)])
    totals = np.concatenate([total[g] - 1, np.where(known, total[place] if len(begin) else 0, 0)])
    every = np.concatenate([train, others])
    there = most > 0
    token = pair[cand] if len(pair) else np.zeros(len(every), np.uint64)
    return there & (token == every), state(most, totals), np.where(there, token & np.uint64(0xFF), 0).astype(np.uint8)


def _answered(asked: DataFrame) -> DataFrame:
    """(portion, kind, key, answer, n, v): for each portion what it asked for, in its order; the tokens and kinds of each range."""

    def answers(kind: int, rows: list[tuple]) -> Iterator[tuple]:
        train = [np.cumsum(unpacked(r[2], np.uint64), dtype=np.uint64) for r in rows]
        times = [unpacked(r[3], np.int64) for r in rows]
        if kind == COUNTS:
            _, own = np.unique(np.concatenate(train), return_inverse=True)
            n = np.bincount(own, np.concatenate(times)).astype(np.int64)
            yield -1, b"", int(n.sum()), int((n > 0).sum())
            for r, part in zip(rows, np.split(n[own], np.cumsum([len(t) for t in train])[:-1]), strict=True):
                yield r[1], packed(part), 0, 0
            return
        others = [np.cumsum(unpacked(r[4], np.uint64), dtype=np.uint64) for r in rows]
        hit, seen, token = candidates(np.concatenate(train), np.concatenate(times), np.concatenate(others))
        ends = np.cumsum([0, *(len(t) for t in train), *(len(t) for t in others)])
        word = ((hit * 128 + seen).astype(np.uint16) << 8) | token
        for i, r in enumerate(rows):
            a, b = ends[i : i + 2], ends[len(rows) + i : len(rows) + i + 2]
            yield r[1], packed(np.concatenate([word[slice(*a)], word[slice(*b)]])), 0, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(p, key % 3, key, blob, n, v) for p, blob, n, v in answers(key % 3, held)], columns=["portion", "kind", "key", "answer", "n", "v"])

        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if row[0] != key:
                    if held:
                        yield done()
                    key, held = row[0], []
                held.append(row)
        if held:
            yield done()

    rows = asked.select("key", "portion", "train", "times", "others")
    return rows.repartition("key").sortWithinPartitions("key", "portion").mapInPandas(run, "portion bigint, kind int, key bigint, answer binary, n bigint, v bigint")


def decided(p: Portion, second: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token its joint state, 20 bits, then 3 bits for live decisions, 2 for the one that meets it (1 to 3; 0 for none)."""
    n, starts = len(p.h), np.cumsum(p.sizes) - p.sizes
    text = np.repeat(np.arange(len(p.sizes)), p.sizes)
    one = np.concatenate([[0], p.tokens[:-1] + 1]).astype(np.int64)
    one[starts] = 0
    key = text * (len(p.vocabulary) + 1) + one
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    last = np.full(n, -1)
    last[order[again + 1]] = order[again]
    seen, own = last >= 0, (p.h.view(np.uint64) >> np.uint64(20)).astype(np.uint8)
    c2, c1, c0 = second.astype(np.uint8), first.astype(np.uint8), np.where(seen, own[last], 0).astype(np.uint8)
    q2, q1 = (((x >> 8) & 0x7F).astype(np.int64) for x in (second, first))
    there2, there1 = q2 > 3, q1 > 3
    live = [there2, seen & ~(there2 & (c0 == c2)), there1 & ~(there2 & (c1 == c2)) & ~(seen & (c1 == c0))]
    hits = [live[0] & (second >> 15 > 0), live[1] & (p.tokens[last] == p.tokens), live[2] & (first >> 15 > 0)]
    code = np.where(hits[0], 1, np.where(hits[1], 2, np.where(hits[2], 3, 0)))
    past = np.concatenate([[0], code[:-1]])
    past[starts] = 0
    older = np.concatenate([[0], past[:-1] > 0])
    older[starts] = 0
    place = np.searchsorted([8, 64, 512], np.arange(n) - np.repeat(starts, p.sizes), side="right")
    agree = seen + 2 * (there2 & seen & (c2 == c0)) + 4 * (there1 & there2 & (c1 == c2)) + 8 * (there1 & seen & (c1 == c0))
    joint = ((((q2 * STATES + q1) * AGREE + agree) * PAST + past) * OLDER + older) * PLACES + place
    return (joint | (live[0] * 1 + live[1] * 2 + live[2] * 4) << 20 | code << 23).astype(np.uint32)


def split(joint: np.ndarray) -> tuple[np.ndarray, ...]:
    """q2, q1, agree, past, older and place of joint states."""
    out = []
    for base in (PLACES, OLDER, PAST, AGREE, STATES):
        joint, rest = np.divmod(joint, base)
        out.append(rest)
    return joint, *out[::-1]


def predictors(joint: np.ndarray) -> list[np.ndarray]:
    """The cell of each predictor for joint states."""
    q2, q1, agree, past, older, place = split(joint)
    return [q2 * AGREE + agree, q1 * AGREE + agree, ((agree * PAST + past) * OLDER + older) * PLACES + place, q2 * STATES + q1, (q2 * PAST + past) * OLDER + older]


def gates(k: int, joint: np.ndarray) -> np.ndarray:
    """By the decision and the count of its candidate, or how the text's own one is backed."""
    q2, q1, agree, *_ = split(joint)
    return k * 6 + (q2 // 4 if k == 0 else q1 // 4 if k == 2 else np.minimum(agree >> 1, 5))


@dataclass(frozen=True)
class Model:
    stretch: np.ndarray  # decisions x joint states x inputs
    gate: np.ndarray  # decisions x joint states
    weights: np.ndarray  # gates x inputs


def logistic(x: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.clip(x, -30, 30))), 1e-6, 1 - 1e-6)


def fitted(trials: np.ndarray, hits: np.ndarray) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """Each predictor's log odds by decision and cell, and the weights by gate, from counts (decisions x joint states).

    Weights minimise the logistic loss over all decisions counted, by Newton's steps with a ridge around equal shares.
    """
    every = np.arange(JOINT)
    cells = predictors(every)
    odds = [[np.log((np.bincount(c, hits[k]) + 0.4) / (np.bincount(c, trials[k] - hits[k]) + 0.4)) for c in cells] for k in range(DECISIONS)]
    start = np.array([1 / PREDICTORS] * PREDICTORS + [0.0])
    weights = np.repeat(start[None], GATES, axis=0)
    for k in range(DECISIONS):
        used = np.flatnonzero(trials[k])
        x = np.stack([odds[k][i][cells[i][used]] for i in range(PREDICTORS)] + [np.ones(len(used))], axis=1)
        gate, t, y = gates(k, used), trials[k][used], hits[k][used]
        for g in np.unique(gate):
            m = gate == g
            xs, ts, ys, w = x[m], t[m], y[m], start.copy()
            for _ in range(12):
                p = logistic(xs @ w)
                slope = xs.T @ (ys - ts * p) - (w - start)
                step = np.linalg.solve((xs * (ts * p * (1 - p))[:, None]).T @ xs + np.eye(INPUTS), slope)
                w += np.clip(step, -1, 1)
                if np.abs(step).max() < 1e-6:
                    break
            weights[g] = w
    return odds, np.round(weights, 9)


def model(odds: list[list[np.ndarray]], weights: np.ndarray) -> Model:
    cells = predictors(np.arange(JOINT))
    stretch = np.ones((DECISIONS, JOINT, INPUTS), np.float32)
    for k in range(DECISIONS):
        for i in range(PREDICTORS):
            stretch[k, :, i] = odds[k][i][cells[i]]
    return Model(stretch, np.stack([gates(k, np.arange(JOINT)) for k in range(DECISIONS)]).astype(np.uint8), weights)


def chances(m: Model, states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The probability of each decision (tokens x decisions, 0 where not live); a text's weights are refined after each of its blocks."""
    n, starts = len(states), np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    joint, code = states & 0xFFFFF, (states >> 23).astype(np.int64)
    out = np.zeros((n, DECISIONS))
    block = (np.arange(n) - starts[text]) // BLOCK
    order = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 2))
    own = np.repeat(m.weights[None], len(sizes), axis=0)
    for a, b in zip(ends, ends[1:]):  # noqa: B905
        at = order[a:b]
        for k in range(DECISIONS):
            i = at[(states[at] >> (20 + k)) & 1 == 1]
            if not len(i):
                continue
            t, g, x = text[i], m.gate[k, joint[i]], m.stretch[k, joint[i]]
            p = logistic(np.einsum("ij,ij->i", x, own[t, g]))
            out[i, k] = p
            fair = (code[i] == 0) | (code[i] > k)  # decisions after the one that met the token teach nothing
            cell, error = t * GATES + g, np.where(fair, (code[i] == k + 1) - p, 0.0)
            some, of = np.unique(cell, return_inverse=True)
            seen = np.sqrt(np.maximum(1, np.bincount(of, fair)))
            for j in range(INPUTS):
                step = np.bincount(of, error * x[:, j]) / seen
                own.reshape(-1, INPUTS)[some, j] += RATE * np.clip(step, -4, 4)
    return out


def mixed(p: np.ndarray, code: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Probability of each token, for its decisions' p, the decision that meets it (1 to 3, 0 for none) and its unigram share."""
    out = share.astype(float)
    for k in range(DECISIONS - 1, -1, -1):
        out = p[:, k] * (code == k + 1) + (1 - p[:, k]) * out
    return out


def _aligned(portions: DataFrame, answers: DataFrame, count: int, width: int) -> DataFrame:
    """A row for each portion with its tokens' states and its vocabulary's counts; and rows of (joint, trials, hits) by task."""
    told = answers.where("portion >= 0").groupBy("portion").agg(F.sort_array(F.collect_list(F.struct("kind", "key", "answer"))).alias("answers"))
    kind = dict(portions.dtypes)["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials, hits = np.zeros((DECISIONS, JOINT), np.int64), np.zeros((DECISIONS, JOINT), np.int64)
        schema = None
        for b in batches:
            schema = schema or b.schema.field("ids").type
            for row in _each(b):
                p = _portion(row)
                blobs = {x: [a["answer"] for a in row["answers"] if a["kind"] == x] for x in (COUNTS, FIRST, SECOND)}
                ((_, at, _),) = p.asked(COUNTS, width)
                counts = np.concatenate([unpacked(x, np.int64) for x in blobs[COUNTS]])[at]
                words = []
                for x in (SECOND, FIRST):
                    train, others = p.asked(x, width)
                    cuts = [np.diff(ranges(s[0], count, x, width)) for s in (train, others)]
                    sizes = [(a, c) for a, c in zip(*cuts, strict=True) if a or c]
                    got = [np.split(unpacked(blob, np.uint16), [a]) for blob, (a, _) in zip(blobs[x], sizes, strict=True)]
                    word = np.zeros(len(p.h), np.uint16)
                    word[p.training] = np.concatenate([g[0] for g in got])[train[1]]
                    word[~p.training] = np.concatenate([g[1] for g in got])[others[1]]
                    words.append(word)
                states = decided(p, *words)
                code = states >> 23
                for k in range(DECISIONS):
                    fair = p.training & ((states >> (20 + k)) & 1 == 1) & ((code == 0) | (code > k))
                    trials[k] += np.bincount(states[fair] & 0xFFFFF, minlength=JOINT)
                    hits[k] += np.bincount(states[fair & (code == k + 1)] & 0xFFFFF, minlength=JOINT)
                yield _row(schema, row["ids"], row["held"], row["n_bytes"], row["sizes"], row["tokens"], packed(counts), packed(states), b"")
        used = np.flatnonzero(trials.ravel())
        if len(used):
            blob = packed(np.concatenate([used, trials.ravel()[used], hits.ravel()[used]]))
            yield _row(schema, None, None, None, None, None, None, None, blob)

    joined = portions.join(told, "portion").select("ids", "held", "n_bytes", "sizes", "tokens", "vocabulary", "answers")
    return joined.mapInArrow(run, f"ids {kind}, held array<boolean>, n_bytes array<bigint>, sizes binary, tokens binary, counts binary, states binary, learned binary")


def _row(ids: pa.DataType, *values) -> pa.RecordBatch:
    kinds = [ids, pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["ids", "held", "n_bytes", "sizes", "tokens", "counts", "states", "learned"])


def _sums(learned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """trials and hits (decisions x joint states) over all tasks: at most that many rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["learned"]:
                at, trials, hits = unpacked(blob, np.int64).reshape(3, -1)
                yield pd.DataFrame({"cell": at, "trials": trials, "hits": hits})

    rows = learned.where("ids is null").select("learned").mapInPandas(run, "cell bigint, trials bigint, hits bigint").groupBy("cell").agg(F.sum("trials").alias("trials"), F.sum("hits").alias("hits")).toPandas()
    trials, hits = np.zeros(DECISIONS * JOINT, np.int64), np.zeros(DECISIONS * JOINT, np.int64)
    trials[rows["cell"]], hits[rows["cell"]] = rows["trials"], rows["hits"]
    return trials.reshape(DECISIONS, JOINT), hits.reshape(DECISIONS, JOINT)


def score(docs: DataFrame, folds: int = 5, portion: int = PORTION) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row of docs(doc_id, text).

    Texts of fold 1 are held out; the others train, those with a null id too. A null or empty text
    is its end token. bits_per_byte is that of the mixed model over the text's bytes, null for no
    bytes. Repeated rows train and are scored each by itself; an empty table gives no rows; without
    a training text all counts are 0; other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    held = F.coalesce(fold(folds=folds) == 1, F.lit(False))
    portions = cut(_portions(docs.select("doc_id", held.alias("held"), F.col("text").cast("binary").alias("text")), portion))
    some, size = portions.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("n_bytes", F.lit(0).cast("bigint"), lambda a, x: a + x + 8)), F.lit(0))).first()
    count = max(1, -(-some // PORTIONS_A_RANGE))
    # so many bits for a context's hash that at every size some 1 in 200 share it with another one
    width = min(40, 28 + (size // 8_000_000).bit_length())
    answers = cut(_answered(_asked(portions, count, width)))
    n, v = answers.where("portion < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    floor = float(np.log10(n + 0.5 * (v + 1)))
    aligned = cut(_aligned(portions, answers, count, width))
    fit = docs.sparkSession.sparkContext.broadcast(fitted(*_sums(aligned)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(*fit.value)
        for b in batches:
            ids = b.column(0)
            for i, row in enumerate(_each(b.drop_columns(["ids"]))):
                sizes, tokens, counts, states = (unpacked(row[c], t) for c, t in (("sizes", np.int64), ("tokens", np.int32), ("counts", np.int64), ("states", np.uint32)))
                starts = np.cumsum(sizes) - sizes
                logs = (np.log10(counts + 0.5) - floor)[tokens]
                p = mixed(chances(m, states, sizes), states >> 23, 10**logs)
                own = ids.slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        own, pa.array(row["held"], pa.bool_()), pa.array(sizes), pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)),
                        pa.array(np.full(len(sizes), n)), pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(np.log10(p), starts)), pa.array(row["n_bytes"], pa.int64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
                )

    found = aligned.where("ids is not null").select("ids", "held", "n_bytes", "sizes", "tokens", "counts", "states").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"
    )
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return found.withColumn("bits_per_byte", bits)
