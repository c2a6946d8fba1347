"""A session with the settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; everything else is the cluster's. conf: further settings, dots as __."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the session has set; a temporary one only for a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="docloom-checkpoint-"))
    return path or sc._jsc.sc().getCheckpointDir().get()


#: Whether a query's shuffle files go when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """The same rows computed now and kept in the shared folder: lost executors do not lose them.

    What was shuffled on the way is removed at once. The session's settings stay as they were.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query of its own, whose shuffles nothing else reads
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def numbered(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """df with its rows' places, from 0, in a total order: ranges are sorted side by side, and only their sizes meet."""
    at = F.monotonically_increasing_id()
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", at))
    part = F.shiftright("__m", 33)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "__p long, __o long")
    return ranged.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__o", "__m")
