"""Scans of what a pipeline leaves behind: JSON lines, graphs, ground truth, curves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.session import numbered


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, expected from JSON lines {doc_id | doc, fields{}}: bad lines are skipped, the last line of a document wins."""
    raw = spark.read.text(path, wholetext=False).withColumn("line", F.monotonically_increasing_id())
    v = raw.select("line", F.try_parse_json("value").alias("v")).where("v is not null")
    rows = v.select("line", F.coalesce(F.try_variant_get("v", "$.doc_id", "string"), F.try_variant_get("v", "$.doc", "string")).alias("doc_id"), F.try_variant_get("v", "$.fields", "map<string,variant>").alias("fields")).where("doc_id is not null and fields is not null")
    last = rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("line")))).where("n = 1")
    return last.select("doc_id", F.explode("fields").alias("path", "x")).select("doc_id", "path", F.col("x").cast("string").alias("expected"))


def parse_failures(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n: failure lines of each document, bad lines skipped."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    return v.groupBy(F.try_variant_get("v", "$.doc", "string").alias("doc_id")).agg(F.count("*").alias("n"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of PDF or HTML files, for a page-emitting provider."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def graph(spark: SparkSession, folder: str, doc_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges that sinks.graph wrote, of one document or of all."""
    found = tuple(spark.read.parquet(f"{folder}/{part}") for part in ("nodes", "edges"))
    return found if doc_id is None else tuple(df.where(F.col("doc_id") == doc_id) for df in found)


def explicit_schema(spark: SparkSession, path: str) -> dict:
    """A JSON schema file, of one file's size; missing or malformed ones raise."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    return json.loads(text)


def evenly(points: DataFrame, order: str, n: int = 40) -> DataFrame:
    """n evenly spaced rows of a curve, nulls dropped: positions floor(i (rows - 1) / (n - 1))."""
    at = numbered(points.dropna(), order, name="__n")
    total = at.count()
    if total == 0:
        return at.drop("__n")
    picks = sorted({i * (total - 1) // max(1, n - 1) for i in range(n)})
    return at.where(F.col("__n").isin(*picks)).drop("__n")


def sampled(listing: DataFrame, n: int, seed: int = 42, key: str = "path") -> DataFrame:
    """n rows by a seeded hash of their key: the same ones on any cluster."""
    return listing.orderBy(F.md5(F.concat(F.col(key), F.lit(str(seed)))), key).limit(n)


#: The models that providers may name.
MODELS = (
    ("layout", "detector", "detector.pt", 0.1), ("vision", "student", "vision-student", 6.0), ("text", "extractor", "text-extractor", 15.0), ("ocr", "reader", "ocr", 0.5), ("structure", "tables", "table-structure", 0.2),
)


def models(spark: SparkSession, name: str | None = None) -> DataFrame:
    """name, role, file, gigabytes of known models."""
    table = spark.createDataFrame(list(MODELS), "name string, role string, file string, gigabytes double")
    return table if name is None else table.where(F.col("name") == name)
