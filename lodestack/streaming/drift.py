"""Drift as a stream: observations arrive, are held against the baseline once each, and the drift is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import drift
from lodestack.plans.pinning import shared_folder

OBSERVED = "grp string, id long, status string, new_sha256 string"


def _base(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_drift(spark: SparkSession, incoming: str, manifest: DataFrame, out: str, checkpoint: str):
    """Reads new observation files below ``incoming``; each batch is written under its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.dropDuplicates(["grp", "id"])
        found = drift.compare(manifest, seen).where("status <> 'not_observed'")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    given = spark.readStream.schema(OBSERVED).parquet(incoming)
    return given.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """One pass over all that is there; the drift of all batches."""
    base = _base(spark)
    observed.select("grp", F.col("id").cast("long").alias("id"), "status", "new_sha256").write.parquet(f"{base}/in")
    stream_drift(spark, f"{base}/in", manifest, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def late_counts(events: DataFrame, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Observations per type and window with a watermark; works on streams and on tables."""
    return events.withWatermark("ts", lateness).groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
