"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every glob is packed into one multiword Shift-And automaton. A `*` is a self-loop of the state
before it, so one pass over a URL simulates all globs: per character
``D = ((D << 1 | first) & fits[c]) | (D & loops[c])``. The pass runs over all URLs of a batch at
once, column by column, in numpy; only URLs that still have characters are touched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 0x110000  # stands between host and path; no text holds it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host suffix and a path prefix, such as example.net and /en/."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Glob:
    """Wildcards for host and path: `*` for any run, `?` for one character."""

    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: The method's own globs decide where no rule fits; without a fitting glob a URL is allowed.
GLOBS = (
    Glob("block", "*", "*.exe"),
    Glob("block", "*", "*/wp-login.php*"),
    Glob("block", "*.doubleclick.*", "*"),
    Glob("block", "ads?.*", "*"),
)


class Automaton:
    """All patterns in W words of 64 bits; bit j of a pattern: its first j+1 symbols are matched."""

    def __init__(self, patterns: Sequence[tuple[str, str]]):
        """patterns: host glob over ``.host`` and path glob."""
        symbols: list[tuple[int | None, bool, bool]] = []  # symbol (None: any), star after it, in the host
        starts: list[tuple[int, bool]] = []
        ends: list[int] = []
        for host, path in patterns:
            starts.append((len(symbols), host.startswith("*")))
            for part, here in ((host, True), (chr(0), False), (path, False)):
                for c in part:
                    if c == "*":
                        if len(symbols) > starts[-1][0]:
                            s, _, h = symbols[-1]
                            symbols[-1] = (s, True, h)
                    else:
                        symbols.append((END if c == chr(0) else None if c == "?" else ord(c), False, here))
            ends.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.alphabet = np.array(sorted({s for s, _, _ in symbols if s is not None}), dtype=np.uint32)
        k = len(self.alphabet) + 1  # the last row is for all other characters
        self.fits, self.loops = np.zeros((k, self.words), np.uint64), np.zeros((k, self.words), np.uint64)
        at = {int(c): i for i, c in enumerate(self.alphabet)}
        end = at.get(END)
        for j, (s, star, here) in enumerate(symbols):
            w, bit = j // 64, np.uint64(1 << (j % 64))
            for i in range(k):
                if (s is None and i != end) or (s is not None and at[s] == i):
                    self.fits[i, w] |= bit
                if star and i != end:
                    self.loops[i, w] |= bit
        self.first, self.always = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for j, star in starts:
            (self.always if star else self.first)[j // 64] |= np.uint64(1 << (j % 64))
        self.ends = [(j // 64, np.uint64(1 << (j % 64))) for j in ends]

    def match(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """A row for each URL and a column for each pattern: whether it fits the whole URL."""
        n = len(hosts)
        text = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for h, p in zip(hosts, paths, strict=True) for x in ("." + h, p)]
        stop = np.array([END], np.uint32)
        flat = np.concatenate([y for i in range(n) for y in (text[2 * i], stop, text[2 * i + 1])]) if n else stop[:0]
        sizes = np.array([len(text[2 * i]) + 1 + len(text[2 * i + 1]) for i in range(n)], dtype=np.int64)
        place = np.searchsorted(self.alphabet, flat)
        place[place == len(self.alphabet)] = 0
        other = len(self.alphabet)
        codes = np.where(self.alphabet[place] == flat, place, other) if other else np.full(len(flat), other)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, left = begin[order], sizes[order]
        state = np.zeros((n, self.words), np.uint64)
        in_host = np.ones(n, bool)
        end = int(np.searchsorted(self.alphabet, END))
        one, high, inner = np.uint64(1), np.uint64(63), ~(self.first | self.always)
        for t in range(int(left[0]) if n else 0):
            live = int(np.searchsorted(-left, -t, side="left"))  # sizes over t
            c = codes[begin[:live] + t]
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> high
            moved &= inner  # a pattern's last bit must not start the next pattern
            moved |= np.where(in_host[:live, None], self.always, np.uint64(0))
            if t == 0:
                moved |= self.first
            state[:live] = (moved & self.fits[c]) | (d & self.loops[c])
            in_host[:live] &= c != end
        out = np.zeros((n, len(self.ends)), bool)
        for k, (w, bit) in enumerate(self.ends):
            out[order, k] = (state[:, w] & bit) != 0
        return out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[Glob] = GLOBS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    The longest fitting rule decides (of equally long ones that with the longer host, then the
    first); where none fits, any blocking glob blocks, else any glob's verdict or the default
    holds. A null URL, or one without ``://``, has an empty host and path, which no rule fits.
    Repeated rows are judged each by itself; an empty table gives no rows; other columns of
    pages are not looked at. No shuffle: a row needs nothing but itself.
    """
    mark = F.instr("url", "://")
    rest = F.when(mark > 0, F.col("url").substr(mark + 3, F.length("url"))).otherwise("")
    parts = (
        pages.select("page_id", "url").select("page_id", rest.alias("__rest"))
        .select("page_id", F.regexp_extract("__rest", r"\A([^/?#]*)([^?#]*)", 1).alias("__host"), F.regexp_extract("__rest", r"\A([^/?#]*)([^?#]*)", 2).alias("path"))
        .select("page_id", F.translate("__host", UPPER, LOWER).alias("host"), "path")
    )
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), -len(rules[i].host), i))
    ordered = [rules[i] for i in ranked]
    patterns = [("*." + r.host, r.path + "*") for r in ordered] + [("." + g.host if g.host[:1] != "*" else g.host, g.path) for g in globs]
    names, verdicts = [r.name for r in ordered], [r.verdict for r in ordered]
    glob_blocks = [g.verdict == "block" for g in globs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(patterns)
        for b in batches:
            fits = machine.match(b.column(1).to_pylist(), b.column(2).to_pylist())
            rule: list[str | None] = []
            verdict: list[str] = []
            by_rule, by_glob = fits[:, : len(names)], fits[:, len(names) :]
            for some, k, g in zip(by_rule.any(1), by_rule.argmax(1) if names else np.zeros(len(fits), int), by_glob, strict=True):
                rule.append(names[k] if some else None)
                blocked = any(x and y for x, y in zip(g, glob_blocks, strict=True))
                verdict.append(verdicts[k] if some else "block" if blocked else "allow" if g.any() else default)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
