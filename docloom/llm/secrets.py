"""Secret scans: patterns, and the entropy of sliding windows over candidate strings.

A window of WINDOW characters slides over each long run of key characters. Counts of its
characters change by one arrival and one departure a step, and so does sum(c * log2 c), from
which its Shannon entropy follows. Everything is a Column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.spans import count, listed, spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{16,}+"
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
BASE = ("assign", "access", "hex")
WINDOW = 20
#: Least entropy, in bits a character, of the best window, by character class.
HEX_BITS, MIXED_BITS = 3.2, 3.8
#: The same for upper-case letters and digits, lower-case letters and digits, letters of both cases, letters of one.
UPPER_BITS, LOWER_BITS, LETTER_BITS, CASE_BITS = 3.5, 3.5, 3.85, 3.65
#: Candidates that are no secrets: placeholders, sample keys, universally unique identifiers.
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0{8}|1234567|abcdefg|\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
LOW, SLOTS = 43, 80  # codes of + to z
MARK = "[secret]"


def least_sum(candidate: Column) -> Column:
    """The least sum(c * log2 c) of all windows of WINDOW characters; the entropy is log2 WINDOW - it / WINDOW."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - LOW)
    f = lambda c: F.get(table, c)

    def step(acc: Column, x: Column) -> Column:
        """x: the arriving code and the departing one, or -1."""
        come, go = x["come"], x["go"]
        grown = F.get(acc["counts"], come)
        added = acc["sum"] + f(grown + 1) - f(grown)
        shrunk = F.get(acc["counts"], go) + F.when(go == come, 1).otherwise(0)
        now = F.when(go < 0, added).otherwise(added - f(shrunk) + f(shrunk - 1))
        counts = F.transform(acc["counts"], lambda c, i: c + F.when(i == come, 1).otherwise(0) - F.when(i == go, 1).otherwise(0))
        full = x["i"] >= WINDOW - 1
        return F.struct(counts.alias("counts"), now.alias("sum"), F.when(full, F.least(acc["least"], now)).otherwise(acc["least"]).alias("least"))

    def slide(code: Column) -> Column:
        moves = F.transform(code, lambda c, i: F.struct(c.alias("come"), F.when(i >= WINDOW, F.get(code, i - WINDOW)).otherwise(-1).alias("go"), i.alias("i")))
        start = F.struct(F.array_repeat(F.lit(0), SLOTS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))
        return F.aggregate(moves, start, step, lambda acc: acc["least"])

    return F.element_at(F.transform(F.array(codes), slide), 1)


def dense(m: Column, _: Column) -> Column:
    """Whether a candidate's best window is as random as its character class asks for, and not allowed."""
    most = lambda bits: WINDOW * (math.log2(WINDOW) - bits)
    hexadecimal = m.rlike(r"\A[0-9A-Fa-f]+\z") & m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    mixed = m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    upper = m.rlike(r"\A[A-Z0-9]+=*\z") & m.rlike("[0-9]") & m.rlike("[A-Z]")
    lower = m.rlike(r"\A[a-z0-9]+=*\z") & m.rlike("[0-9]") & m.rlike("[a-z]")
    letters = m.rlike(r"\A[A-Za-z]+=*\z")
    both = letters & m.rlike("[a-z]") & m.rlike("[A-Z]")
    least = F.when(hexadecimal, most(HEX_BITS)).when(mixed, most(MIXED_BITS)).when(upper, most(UPPER_BITS)).when(lower, most(LOWER_BITS)).when(both, most(LETTER_BITS)).when(letters, most(CASE_BITS))
    return F.when(least.isNotNull() & ~m.rlike(ALLOWED), least_sum(m) <= least).otherwise(False)


def marked(docs: DataFrame) -> DataFrame:
    """docs with a column __spans."""
    text = F.col("__text")
    long = lambda _, g: F.length(g) >= 12
    yes = lambda m, _: F.lit(True)
    base = F.concat(
        spans(text, ASSIGN, "assign", 0, long, text.contains("=") | text.contains(":"), group=1),
        spans(text, ACCESS, "access", 1, yes, text.contains("AKIA")),
        spans(text, HEX, "hex", 2, yes),
    )
    more = spans(text, CANDIDATE, "entropy", 3, dense)
    read = docs.withColumn("__text", F.coalesce("text", F.lit(""))).withColumns({"__base": base, "__more": more})
    new = F.filter("__more", lambda m: ~F.exists("__base", lambda b: (b["begin"] <= m["begin"]) & (m["end"] <= b["end"])))
    return read.withColumn("__spans", F.sort_array(F.concat("__base", new))).drop("__text", "__base", "__more")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (begin, rank, end, kind, match, group), for every row of docs(doc_id, text).

    Places are code points, ends exclusive, over the whole text. Base kinds stay as matched; an
    entropy span is added unless one base span covers all of it. A null or empty text has no spans;
    repeated rows are judged each by itself; an empty table gives no rows. No shuffle, no Python.
    """
    return marked(docs.select("doc_id", "text")).select("doc_id", F.col("__spans").alias("spans"))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every secret's span in text replaced by a mark, and n_chars, where there is one, set anew.

    Overlapping spans give one mark. Rows without spans stay as they are.
    """
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr(acc["at"] + 1, F.greatest(s["begin"] - acc["at"], F.lit(0)))
        out = F.when(s["begin"] >= acc["at"], F.concat(acc["out"], F.array(gap))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate("__spans", start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, F.length(text)))), mark))
    out = marked(docs).withColumn("__hit", F.size("__spans") > 0).withColumn("text", F.when(F.col("__hit"), new).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__hit"), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' checksum and the list of all spans."""
    every = F.col("spans")
    base = F.filter(every, lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(every, k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))
