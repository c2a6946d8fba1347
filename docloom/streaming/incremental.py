"""The graph build over documents as they arrive: each file is handled once, documents are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docloom.operators import graph


def regions_of(lines: DataFrame) -> DataFrame:
    """Lines of documents(doc_id, text) as regions: the first a title, short ones headings."""
    at = lines.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.length("text") > 0)
    kind = F.when(F.col("i") == 0, "title").when(F.col("text").contains(" | "), "table").when(F.length("text") < 60, "heading").otherwise("text")
    return at.select("doc_id", F.lit(1).alias("page"), (F.col("i") + 1).cast("int").alias("region_idx"), kind.alias("type"), "text")


def arriving(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string", files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, at most so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def build(docs: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Nodes of each batch's documents, written under the batch's number so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        graph.nodes(regions_of(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def trace_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of trace events by type in windows; a watermark bounds what is kept."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
