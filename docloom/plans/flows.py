"""Queries of JSON repair, providers, scans, sinks and streams, and DuckDB SQL where it can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import json_tools as js
from docloom.operators import graph, providers
from docloom.operators import records as rec
from docloom.session import shared_folder
from docloom.sources import readers, sinks
from docloom.sources.fixtures import load, oracle
from docloom.streaming import incremental

Q: dict = {}
O: dict = {}  # noqa: E741


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


def scratch(spark) -> str:
    """A new folder within the shared one."""
    return f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}"


@query("json_salvage", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_salvage(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id") % 5
    said = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(i == 2, F.concat(F.regexp_replace("props", r"\}$", ",}"), F.lit(" done"))).when(i == 3, F.regexp_replace("props", r"\}$", "")).otherwise(F.concat(F.lit("{\"k\": "), F.get_json_object("props", "$.k"), F.lit(", \"x\": [1, {\"y\": \"z")))
    return e.select("event_id", F.get_json_object(js.salvaged(said), "$.k").cast("bigint").alias("k"))


@query("record_leaves", "select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events")
def record_leaves(spark, sf):
    v = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>").alias("m"))
    return v.select("event_id", F.explode("m").alias("path", "x")).select("event_id", "path", F.col("x").cast("string").alias("value"))


@query("typed_record", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(null as varchar) as reasoning_thoughts from events")
def typed_record(spark, sf):
    kind = js.compiled({"properties": {"k": {"type": ["integer", "null"]}}}, discovered=False)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", kind).alias("r")).select("event_id", "r.k", "r.reasoning_thoughts")


@query("provider_extract", oracle(r"select doc_id, regexp_extract(text || ' Invoice No: AB-' || doc_id || '7 total USD 5', '(?i)invoice\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*\d)', 1) as invoice_number, 'ok' as status from f_domain_text", "domain_text"))
def provider_extract(spark, sf):
    t = load(spark, sf, "domain_text").withColumn("text", F.concat("text", F.lit(" Invoice No: AB-"), "doc_id", F.lit("7 total USD 5")))
    return providers.extracted(t, "rule").select("doc_id", F.get_json_object("answer", "$.invoice_number").alias("invoice_number"), "status")


@query("provider_null", "select doc_id, 'failed' as status from documents")
def provider_null(spark, sf):
    return providers.extracted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "null").select("doc_id", "status")


@query("extract_end_to_end", oracle(r"""
with t as (select doc_id, length(text) as n, text || ' Invoice No: AB-' || doc_id || '7 total USD 5' as text from f_domain_text)
select doc_id, regexp_extract(text, '(?i)invoice\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]*\d)', 1) as invoice_number, regexp_extract(text, '\b(USD|EUR|GBP|INR|JPY|CNY|MXN|BRL|AUD|CAD|CHF|SGD)\b', 1) as currency from t""", "domain_text"))
def extract_end_to_end(spark, sf):
    t = load(spark, sf, "domain_text").withColumn("text", F.concat("text", F.lit(" Invoice No: AB-"), "doc_id", F.lit("7 total USD 5")))
    pieces = t.select("doc_id", F.lit(0).alias("node_idx"), F.col("text").alias("content"))
    batches = graph.batches(pieces, 4000).select("doc_id", "batch_idx", F.col("content").alias("text"))
    answers = providers.extracted(batches, "rule").where("status = 'ok'").select("doc_id", "batch_idx", js.salvaged(F.col("answer")).alias("j"))
    m = answers.select("doc_id", "batch_idx", F.explode(F.from_json("j", "map<string,string>")).alias("path", "value")).withColumn("k", F.lit(0))
    wide = rec.projected(rec.merged(m), rec.inferred(t), {"invoice_number": "", "currency": ""})
    return wide


@query("evenly_sampled_curve", "with r as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as p, count(*) over () as n from orders) select o_orderkey, o_totalprice from r where p in (select unnest(range(0, 40)) * (n - 1) // 39)")
def evenly_sampled_curve(spark, sf):
    return readers.evenly(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("corpus_sample", "select cast(doc_id as varchar) as path, source from documents order by md5(concat(cast(doc_id as varchar), '42')), path limit 50")
def corpus_sample(spark, sf):
    return readers.sampled(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "source"), 50)


@query("model_manifest", "select * from (values " + ", ".join(f"('{a}', '{b}', '{c}', {d} :: double)" for a, b, c, d in readers.MODELS) + ") t(name, role, file, gigabytes)")
def model_manifest(spark, sf):
    return readers.models(spark)


@query("ground_truth_scan", oracle("select doc_id, path, expected from (select cast(doc_id as varchar) as doc_id, path, expected from f_truth)", "truth"))
def ground_truth_scan(spark, sf):
    t = load(spark, sf, "truth").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "expected"))).alias("fields")).select(F.col("doc_id").cast("string").alias("doc_id"), "fields")
    folder = scratch(spark)
    t.write.json(folder)
    spark.createDataFrame([("not json",), ("{\"doc\": 5}",)], "value string").coalesce(1).write.mode("append").text(folder)
    return readers.ground_truth(spark, folder)


@query("graph_round_trip", oracle("select doc_id, count(*) as n_nodes from (select distinct doc_id, type, page from f_html) group by doc_id", "html"))
def graph_round_trip(spark, sf):
    n = load(spark, sf, "html").select("doc_id", "type", "page").distinct()
    folder = scratch(spark)
    sinks.graph(n, n.select("doc_id", F.lit(0).alias("src"), F.lit(0).alias("dst")), folder)
    return readers.graph(spark, folder)[0].groupBy("doc_id").agg(F.count("*").alias("n_nodes"))


@query("scorecards_csv", oracle("select doc_id, status, gt_field_f1 as f1, cast(null as varchar) as note from f_scorecard where condition = 0 union all select doc_id, status, null, 'A' || condition from f_scorecard where condition = 1", "scorecard"))
def scorecards_csv(spark, sf):
    s = load(spark, sf, "scorecard")
    folder = scratch(spark)
    every = sinks.csv([s.where("condition = 0").select("doc_id", "status", F.col("gt_field_f1").alias("f1")), s.where("condition = 1").select("doc_id", "status", F.concat(F.lit("A"), "condition").alias("note"))], folder)
    return spark.read.schema(every.schema).csv(folder, header=True)


@query("stream_graph_build", oracle("with l as (select doc_id, unnest(string_split(text, chr(10))) as t from documents) select doc_id, sum(case when length(t) > 0 then 1 else 0 end) as n_regions from l group by doc_id having n_regions > 0", "html"))
def stream_graph_build(spark, sf):
    folder, stream = scratch(spark), scratch(spark)
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(4, "doc_id").write.parquet(folder)
    incremental.build(incremental.arriving(spark, folder, files=2), f"{stream}/out", f"{stream}/state").awaitTermination()
    return spark.read.parquet(f"{stream}/out").groupBy("doc_id").agg(F.sum("region_count").alias("n_regions"))


@query("trace_rates", "select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def trace_rates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return incremental.trace_rates(e).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


