"""Personal data: regular expressions propose spans, checksums confirm, context adjusts the score.

Everything is a Column expression. The patterns mark the same leftmost non-overlapping matches as
their plain forms but never scan a run of characters twice: a match begins where its run begins,
or where the last match ended, and runs are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.spans import count, let, listed, spans

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++"
BASE = ("email", "ip", "card", "phone")
# National lengths of an international bank account number.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: Score before and after a word of the kind's context within REACH code points of the span.
SCORES = {"email": (0.8, 0.95), "ip": (0.5, 0.8), "card": (0.8, 0.95), "phone": (0.6, 0.85), "iban": (0.8, 0.95), "ssn": (0.3, 0.7)}
CONTEXT = {
    "email": "mail|contact|write to|kontakt|correo", "ip": r"\bip\b|address|server|host|adresse", "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|anruf", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social security|taxpayer",
}
REACH, LEAST = 40, 0.5


def ip_parts(m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return m.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")


def luhn(m: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of 10."""

    def summed(digits: Column) -> Column:
        n = F.size(digits)
        value = F.transform(digits, lambda d, i: let(d.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
        return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0

    few = F.length(F.regexp_replace(m, "[^0-9]", "")).between(14, 19)
    return F.when(few, let(F.regexp_extract_all(m, F.lit("[0-9]"), F.lit(0)), summed)).otherwise(False)


def mod_97(m: Column) -> Column:
    """A known country's length, and the remainder 1 of the rearranged number by 97."""
    country = F.substring(m, 1, 2)
    sized = F.lit(False)
    for code, n in IBAN_LENGTHS.items():
        sized = sized | ((country == code) & (F.length(m) == n))
    turned = F.concat(m.substr(F.lit(5), F.length(m)), F.substring(m, 1, 4))
    rest = F.aggregate(F.transform(F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0)), lambda c: F.ascii(c)), F.lit(0), lambda a, x: (a * F.when(x >= 65, 100).otherwise(10) + F.when(x >= 65, x - 55).otherwise(x - 48)) % 97)
    return F.when(sized, rest == 1).otherwise(False)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (begin, rank, end, kind, score), for every row of docs(doc_id, text).

    Places are code points, ends exclusive, over the whole text. Base kinds (email, ip, card,
    phone) keep every match that passes its checksum or digit count, whatever the score; the added
    ones (iban with its mod-97 remainder, ssn) need a score of LEAST or more, which for ssn takes a
    context word. A null or empty text has no spans; repeated rows are judged each by itself; an
    empty table gives no rows; other columns are not read. No shuffle and no Python.
    """
    text = F.col("__text")
    yes = lambda m, _: F.lit(True)
    found = [
        spans(text, EMAIL, "email", 0, yes, text.contains("@")),
        spans(text, IP, "ip", 1, lambda m, _: ip_parts(m), text.contains(".")),
        spans(text, CARD, "card", 2, lambda m, _: luhn(m)),
        spans(text, PHONE, "phone", 3, lambda m, _: F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15), text.contains("+")),
        spans(text, IBAN, "iban", 4, lambda m, _: mod_97(m)),
        spans(text, SSN, "ssn", 5, lambda m, _: m.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), text.contains("-")),
    ]

    def scored(s: Column) -> Column:
        near = F.lower(text.substr(F.greatest(s["begin"] - REACH + 1, F.lit(1)), s["end"] - s["begin"] + 2 * REACH))
        score = F.lit(0.0)
        for kind, (plain, helped) in SCORES.items():
            score = F.when(s["kind"] == kind, F.when(near.rlike(CONTEXT[kind]), helped).otherwise(plain)).otherwise(score)
        return F.struct(s["begin"].alias("begin"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), score.alias("score"))

    every = F.concat(*found)
    kept = F.filter(F.transform(every, scored), lambda s: (s["rank"] < len(BASE)) | (s["score"] >= LEAST))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).select("doc_id", F.sort_array(kept).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' checksum and the list of all spans."""
    every = F.col("spans")
    base = F.filter(every, lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(every, k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))
