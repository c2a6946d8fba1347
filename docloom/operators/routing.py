"""Domains of documents by their vocabulary, and the schema families they lead to."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabulary of the domains, in the order in which ties are decided.
AUDIT = {
    "Corporate": (r"\binvoice\b", r"\bquotation\b", r"\bquote\b", r"\bport of loading\b", r"\bport of destination\b", r"\bsurcharge\b", r"\bcurrency\b", r"\busd\b|\beur\b|\bgbp\b", r"\bper container\b", r"\btotal\b"),
    "Industrial": (r"\bvoltage\b", r"\bcurrent\b", r"\bconnector\b", r"\bpin\b", r"\bled\b", r"\bm12\b|\bm8\b", r"\bdatasheet\b", r"\bpart number\b|\bart\.? no\b"),
    "Academic": (r"\babstract\b", r"\bmethodology\b", r"\breferences\b", r"\bconclusion\b", r"\bcitation\b"),
    "Legal": (r"\bagreement\b", r"\bhereby\b", r"\bclause\b", r"\bparty\b", r"\bpursuant\b", r"\bterms and conditions\b"),
}
SCOUT = {
    "Invoice": (r"\binvoice\b", r"\brechnung\b", r"\bbill to\b", r"\bship to\b", r"\bquantity\b", r"\bunit price\b", r"\bsubtotal\b", r"\bvat\b", r"\bgrand total\b", r"\bamount due\b"),
    "Logistics": (r"\bquotation\b", r"\bquote no\b", r"\bport of (loading|destination)\b", r"\bbunker\b", r"\bcontainer\b", r"\bsurcharge\b", r"\bfreight\b", r"\btariff\b", r"\bbill of lading\b"),
    "Industrial": (r"\bdatasheet\b", r"\bart\.?\s*no\b", r"\bsupply voltage\b", r"\bpin assignment\b|\bpinout\b", r"\bm12\b|\bm8\b", r"\bip\s*6[0-9]\b", r"\bconnector\b", r"\bled\b", r"\bdiagnostic\b"),
    "Academic": (r"\babstract\b", r"\bmethodology\b", r"\breferences\b", r"\bconclusion\b", r"\bdoi:\b", r"\barxiv\b"),
    "Legal": (r"\bagreement\b", r"\bhereby\b", r"\bclause\b", r"\bpursuant\b", r"\bterms and conditions\b", r"\bparty\b"),
    "Medical_Record": (r"\bpatient\b", r"\bdiagnosis\b", r"\bprescription\b", r"\bmedical record\b", r"\bphysician\b", r"\bicd-?10\b"),
}
SUBTYPES = {
    "manual": (r"\btable of contents\b", r"\bchapter\s+\d", r"\binstallation\b", r"\bsafety\s+instructions?\b", r"\bconfiguration\b", r"\bfirmware\s+update\b", r"\btroubleshoot", r"\bwiring\s+diagram\b", r"\bmounting\s+instructions?\b", r"\bprocedure\b"),
    "product": (r"\bproduct-pdf\b", r"\bfor article\b", r"\bart\.?\s*no\b", r"\bcable length\b", r"\bpackaging unit\b", r"\bgtin\b", r"\beclass[-\s]\d", r"\betim[-\s]\d", r"\bcustoms tariff number\b", r"\bno\.? of poles\b", r"\bfamily construction form\b"),
    "datasheet": (r"\bdatasheet\b", r"\bdata\s+sheet\b", r"\btechnical\s+specifications?\b", r"\bspecification\s+sheet\b", r"\bart\.?\s*no\.?\b|\bart\.?\s*nr\.?\b", r"\boperating\s+voltage\b", r"\bsupply\s+voltage\b", r"\bprotection\s+class\b|\bip\s*6[0-9]\b", r"\bm12\b|\bm8\b", r"\bpin\s+assignment\b|\bpinout\b"),
}
CUES = {
    "commercial": (r"\binvoice\b", r"\bquotation\b", r"\bsurcharge\b", r"\bper\s+container\b", r"\bcurrency\b", r"\btotal\b"),
    "technical": (r"\bvoltage\b", r"\bconnector\b", r"\bpins?\b", r"\bm12\b", r"\bdatasheet\b", r"\bled\b"),
    "product": (r"\bproduct-pdf\b", r"\bfor article\b", r"\bart\.?\s*no\b", r"\bcable length\b", r"\bpackaging unit\b", r"\bgtin\b", r"\beclass[-\s]\d", r"\betim[-\s]\d"),
}
FAMILIES = {
    "Industrial": "hardware_v1", "Industrial_product_pdf": "product_pdf_v1", "Industrial_datasheet": "technical_datasheet_v1", "Industrial_manual": "hardware_v1",
    "General": "general_v1", "Legal": "general_v1", "Academic": "general_v1", "Corporate": "invoice_v1",
}
MODULES = {
    "Industrial": ("Electrical Parameters", "Mechanical Parameters", "Connector Pin Assignments", "LED Diagnostics"),
    "Industrial_manual": ("Electrical Parameters", "Mechanical Parameters", "Connector Pin Assignments", "LED Diagnostics"),
    "Industrial_product_pdf": ("Product Identity", "Connector Summary", "Electrical Parameters", "Standards & Certifications", "Commercial Data"),
    "Industrial_datasheet": ("Electrical Parameters", "Mechanical Parameters", "Connector Pin Assignments", "LED Diagnostics", "Standards & Certifications"),
    "Corporate": ("Invoice Header", "Line Items", "Totals", "VAT"),
}


def needles(pattern: str) -> tuple[str, ...]:
    """Letters that a text must hold for each alternative of a pattern to occur; none where one has no such start."""
    found = []
    depth, part, parts = 0, "", []
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    for alternative in [*parts, part]:
        m = re.match(r"(?:\\b)?([a-z0-9 -]+)([?*]?)", alternative)
        start = (m[1][:-1] if m[2] else m[1]) if m else ""
        if not start:
            return ()
        found.append(start)
    return tuple(found)


def occurs(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs in lower-cased text; a cheap search for its letters comes first."""
    held = [text.contains(n) for n in needles(pattern)]
    return reduce(lambda a, b: a | b, held) & text.rlike(pattern) if held else text.rlike(pattern)


def scored(docs: DataFrame, buckets: dict[str, tuple[str, ...]]) -> DataFrame:
    """docs with one column for each bucket: how many of its patterns occur."""
    low = F.col("__low")
    count = lambda patterns: reduce(lambda a, b: a + b, [occurs(low, p).cast("int") for p in patterns])
    return docs.withColumn("__low", F.lower("text")).withColumns({f"s_{k.lower()}": count(p) for k, p in buckets.items()}).drop("__low")


def domain(docs: DataFrame, buckets: dict[str, tuple[str, ...]], digits: int) -> DataFrame:
    """doc_id, domain, confidence: the bucket with most patterns, the first of equals; General without any."""
    s = scored(docs, buckets)
    names = [f"s_{k.lower()}" for k in buckets]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    best = F.greatest(*names)
    pick = F.when(total == 0, "General")
    for k, n in zip(buckets, names, strict=True):
        pick = pick.when(F.col(n) == best, k)
    return s.select("doc_id", pick.alias("domain"), F.when(total == 0, 0.0).otherwise(F.round(best / total, digits)).alias("confidence"))


def industrial_subtype(docs: DataFrame) -> DataFrame:
    """doc_id, subtype: product_pdf, technical_manual or technical_datasheet."""
    s = scored(docs, SUBTYPES)
    m, p, d = F.col("s_manual"), F.col("s_product"), F.col("s_datasheet")
    return s.select("doc_id", F.when((p >= F.greatest(d, m)) & (p >= 2), "product_pdf").when(m > d, "technical_manual").otherwise("technical_datasheet").alias("subtype"))


def schema_cues(docs: DataFrame) -> DataFrame:
    """doc_id and whether commercial, technical and product fields belong in its draft schema."""
    low = F.col("__low")
    return docs.withColumn("__low", F.lower("text")).select("doc_id", *[reduce(lambda a, b: a | b, [occurs(low, x) for x in p]).alias(k) for k, p in CUES.items()])


def audited(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, domain, family, confidence, source: the vocabulary's domain where it is sure, else Industrial as the fallback without a model."""
    found = domain(docs, AUDIT, 4).join(industrial_subtype(docs), "doc_id")
    sure = F.col("confidence") >= least
    base = F.when(sure, F.col("domain")).otherwise("Industrial")
    effective = F.when(base != "Industrial", base).when(F.col("subtype") == "product_pdf", "Industrial_product_pdf").when(F.col("subtype") == "technical_datasheet", "Industrial_datasheet").otherwise("Industrial_manual")
    return found.select("doc_id", effective.alias("domain"), family(effective).alias("family"), "confidence", F.when(sure, "heuristic").otherwise("fallback").alias("source"))


def family(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in FAMILIES.items():
        out = out.when(name == k, v)
    return out.otherwise("general_v1")


def canonical(name: Column) -> Column:
    """Lower case; all Industrial kinds as one, medical names as one."""
    d = F.lower(F.trim(name))
    return F.when(d.isNull(), "").when(d.startswith("industrial"), "industrial").when(d.isin("medical", "medical_record", "medical record"), "medical_record").otherwise(d)


def registry(spark: SparkSession) -> DataFrame:
    """domain, family, modules: the fixed table of schemas."""
    rows = [(d, f, ", ".join(MODULES.get(d, ()))) for d, f in FAMILIES.items()]
    return spark.createDataFrame(rows, "domain string, family string, modules string")
