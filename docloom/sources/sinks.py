"""Where results go: tables, JSON lines, CSV and text, written by the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A document graph as two Parquet tables, sorted by document within files so that scans skip others."""
    for part, df in (("nodes", nodes), ("edges", edges)):
        df.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{folder}/{part}")


def text(documents: DataFrame, column: str, folder: str, buckets: int = 64) -> None:
    """One line of text for each document, in folders by a hash of its id."""
    out = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.col(column).alias("value"))
    out.write.mode("overwrite").partitionBy("bucket").text(folder)


def json_lines(rows: DataFrame, folder: str, append: bool = True) -> None:
    """Traces and records as JSON lines."""
    rows.write.mode("append" if append else "overwrite").json(folder)


def csv(parts: list[DataFrame], folder: str) -> DataFrame:
    """Scorecards of several runs as CSV whose header has all their columns, in the order in which they first occur."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    every.write.mode("overwrite").option("header", True).csv(folder)
    return every


def distilled(rows: DataFrame, folder: str, least: int = 10) -> None:
    """Training records with thoughts of `least` characters or more, appended as JSON lines."""
    rows.where(F.length(F.trim("thoughts")) >= least).select(F.current_timestamp().cast("string").alias("timestamp"), "instruction", "input_context", "thoughts", "output_json").write.mode("append").json(folder)
