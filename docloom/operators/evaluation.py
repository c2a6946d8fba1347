"""Scorecards of records, and reports over a corpus of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_empty, strip

# The failure classes.
FAILURES = {"F1": "parse_failure", "F2": "schema_mismatch", "F3": "empty_field", "F4": "routing_error", "F5": "pipeline_failure"}
METRICS = ("schema_validity_rate", "required_field_completion_rate", "grounded_reference_rate", "gt_field_f1")
UNCOUNTED = ("confidence_score", "reasoning_thoughts", "page_references", "status", "error", "details")


def completion(record: DataFrame, required: list[str]) -> DataFrame:
    """doc_id, required_missing (sorted), rate: 1 where nothing is required."""
    have = record.where(~is_empty(F.col("value")) & F.col("path").isin(*required)).groupBy("doc_id").agg(F.collect_set("path").alias("have"))
    every = record.select("doc_id").distinct().join(have, "doc_id", "left")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]).cast("array<string>"), F.coalesce("have", F.array().cast("array<string>"))))
    rate = (len(required) - F.size("required_missing")) / F.lit(len(required)) if required else F.lit(1.0)
    return every.select("doc_id", missing.alias("required_missing")).withColumn("rate", F.round(rate, 4))


def matches(expected: Column, value: Column) -> Column:
    """Whether one text holds the other, without regard to case and outer blanks; nothing matches an empty one."""
    a, b = strip(F.lower(expected)), strip(F.lower(value))
    return F.coalesce((a != "") & (b != "") & (b.contains(a) | a.contains(b)), F.lit(False))


def truth_metrics(record: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, precision, recall, f1, matched, missing, extra against (doc_id, path, expected).

    Precision counts matched paths over filled top-level fields, so nested truth can lift it over 1.
    """
    filled = record.where(~is_empty(F.col("value")))
    top = filled.groupBy("doc_id").agg(F.countDistinct(F.element_at(F.split("path", r"\."), 1)).alias("filled"), F.collect_set("path").alias("paths"))
    t = truth.join(filled.select("doc_id", "path", "value"), ["doc_id", "path"], "left").withColumn("hit", matches(F.col("expected"), F.col("value")))
    per = t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("path")))).alias("matched"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("path")))).alias("missing"), F.collect_list("path").alias("asked"))
    j = per.join(top, "doc_id", "left").fillna(0, ["filled"])
    p, r = F.when(F.col("filled") > 0, F.col("hits") / F.col("filled")).otherwise(0.0), F.col("hits") / F.col("n")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    extra = F.array_sort(F.array_except(F.coalesce("paths", F.array().cast("array<string>")), "asked"))
    return j.select("doc_id", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), "matched", "missing", extra.alias("extra"))


def flat_metrics(record: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, precision, recall, f1, missing over top-level keys only, against (doc_id, path, expected).

    A key with parts under it is filled; its value is its normalized_value, else its raw_value, else none.
    """
    key = F.element_at(F.split("path", r"\."), 1)
    at = lambda end: F.max(F.when(F.col("path") == F.concat("key", F.lit(end)), F.col("value")))
    keys = record.withColumn("key", key).groupBy("doc_id", "key").agg(F.coalesce(at(""), at(".normalized_value"), at(".raw_value")).alias("value"), F.count_if((F.col("path") != F.col("key")) | (F.col("value") != "")).alias("parts")).where("parts > 0")
    hit = matches(F.col("expected"), F.col("value"))
    t = truth.join(keys.select("doc_id", F.col("key").alias("path"), "value"), ["doc_id", "path"], "left").withColumn("hit", hit)
    per = t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("path")))).alias("missing"))
    j = per.join(keys.groupBy("doc_id").agg(F.count("*").alias("filled")), "doc_id", "left").fillna(0, ["filled"])
    p, r = F.when(F.col("filled") > 0, F.col("hits") / F.col("filled")).otherwise(0.0), F.col("hits") / F.col("n")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return j.select("doc_id", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), "missing")


def clean_truth(fields: DataFrame) -> DataFrame:
    """fields(doc_id, path, value, items) without null and empty values; of lists the items that are neither, an empty list stays."""
    kept = F.filter("items", lambda v: v != "")
    return fields.withColumn("items", kept).where(F.col("items").isNotNull() | (F.col("value") != ""))


def scorecards(record: DataFrame, required: list[str]) -> DataFrame:
    """doc_id and the single-document rates of a record."""
    done = completion(record, required)
    last = F.element_at(F.split("path", r"\."), 1)
    filled = ~is_empty(F.col("value"))
    flags = record.groupBy("doc_id").agg(F.max((filled & ~last.isin(*UNCOUNTED)).cast("double")).alias("non_empty"), F.max((filled & F.col("path").isin("page_references", "source_evidence")).cast("double")).alias("grounded"))
    valid = (F.size("required_missing") == 0).cast("double")
    return done.join(flags, "doc_id").select("doc_id", valid.alias("schema_validity_rate"), F.col("rate").alias("required_field_completion_rate"), F.col("non_empty").alias("non_empty_extraction_rate"), F.col("grounded").alias("grounded_reference_rate"), F.lit(len(required)).cast("bigint").alias("required_total"), F.size("required_missing").cast("bigint").alias("required_missing_count"))


def failure_classes() -> Column:
    """array<string> of failure codes of a scorecard row."""
    missing, total = F.col("required_missing_count"), F.col("required_total")
    f4, f3 = (missing > 0) & (total > 0) & (missing == total), (missing > 0) & ~((total > 0) & (missing == total))
    codes = F.array(
        F.when(F.col("parse_failure_count") > 0, "F1"), F.when(f4, "F4"), F.when(f3, "F3"), F.when((F.col("schema_validity_rate") == 0) & ~f4 & ~f3, "F2")
    )
    return F.when(F.col("status") == "pipeline_error", F.array(F.lit("F5"))).otherwise(F.array_compact(codes))


def failures(cards: DataFrame) -> DataFrame:
    """code, label, n over all scorecards; codes without a failure have 0."""
    codes = cards.sparkSession.createDataFrame(list(FAILURES.items()), "code string, label string")
    seen = cards.select(F.explode(failure_classes()).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return codes.join(F.broadcast(seen), "code", "left").fillna(0, ["n"])


def report(cards: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, mean, std (0 for one value), min, max, n over scorecards that have it; one scan, no explosion of rows."""
    stats = cards.agg(*[f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(f"mean_{m}", 4).alias("mean"), F.round(F.coalesce(f"std_{m}", F.lit(0.0)), 4).alias("std"), F.round(f"min_{m}", 4).alias("min"), F.round(f"max_{m}", 4).alias("max"), F.col(f"n_{m}").alias("n")) for m in metrics])
    return stats.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def success(cards: DataFrame) -> DataFrame:
    """n_docs, n_success, n_failure, success_rate."""
    n, good = F.count("*"), F.count_if(F.col("status") == "success")
    return cards.agg(n.alias("n_docs"), good.alias("n_success"), (n - good).alias("n_failure"), F.round(F.coalesce(F.try_divide(good, n), F.lit(0.0)), 4).alias("success_rate"))


def ablation(cards: DataFrame, conditions: tuple[str, ...] = ("A0", "A1", "A2", "A3"), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric and its mean under each condition."""
    long = cards.withColumn("c", F.concat(F.lit("A"), F.col("condition"))).unpivot(["c"], list(metrics), "metric", "v")
    wide = long.groupBy("metric").pivot("c", list(conditions)).agg(F.avg("v"))
    return wide.select("metric", *[F.round(c, 4).alias(c) for c in conditions])


def retention(special: DataFrame, teacher: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, teacher, specialist, retention: the specialist's share of the teacher's mean, 1 at most, null without one."""
    mean = lambda df, name: df.agg(*[F.avg(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", name)
    j = mean(teacher, "teacher").join(mean(special, "specialist"), "metric")
    kept = F.least(F.col("specialist") / F.nullif("teacher", F.lit(0.0)), F.lit(1.0))
    return j.select("metric", F.round("teacher", 4).alias("teacher"), F.round("specialist", 4).alias("specialist"), F.round(F.when(F.col("specialist").isNotNull(), kept), 4).alias("retention"))


def coverage(truth: DataFrame) -> DataFrame:
    """path, n, share of annotated documents."""
    total = truth.agg(F.countDistinct("doc_id")).first()[0]
    per = truth.groupBy("path").agg(F.countDistinct("doc_id").alias("n"))
    return per.select("path", "n", F.round(F.col("n") / F.lit(max(1, total)), 4).alias("share"))


def enriched(cards: DataFrame, metrics: DataFrame) -> DataFrame:
    """cards with f1 of their document's ground truth: 0 for failed ones, as before without truth."""
    j = cards.join(metrics.select("doc_id", F.col("f1").alias("__f1")), "doc_id", "left")
    return j.withColumn("gt_field_f1", F.when(F.col("__f1").isNull(), F.col("gt_field_f1")).when(F.col("status") == "failed", 0.0).otherwise(F.col("__f1"))).drop("__f1")
