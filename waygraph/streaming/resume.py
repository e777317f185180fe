"""Resuming: done sets, streams over arrivals, versioned caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records whose tile is not done."""
    return records.join(done.select("tile_id"), "tile_id", "left_anti")


def stream_once(spark: SparkSession, source: str, schema, step, sink: str, checkpoint: str, files_per_trigger: int = 8) -> None:
    """Run ``step`` over all Parquet files that have come since the last call.

    Each micro-batch overwrites its own folder of ``sink``, so that a batch that is run
    again after a failure leaves its rows once. The checkpoint remembers what was read.
    """

    def put(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_rejects(rows: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with their reason: a bad tile doesn't end the run."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def cached(spark: SparkSession, path: str, version: str, build) -> DataFrame:
    """The table at ``path`` if it is of this version, else built and kept under it."""
    at = f"{path}/version={version}"
    try:
        return spark.read.parquet(at)
    except Exception as e:  # noqa: BLE001  no such table, or one without files
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: events by window and type, batch or stream. ts is cast, as a watermark needs."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))


def save_then_log(rows: DataFrame, path: str, log: str) -> None:
    """Appends rows to ``path``, and only when that has succeeded their tiles (tile_id) to the done log, as JSON lines."""
    rows.write.mode("append").parquet(path)
    rows.select("tile_id").distinct().write.mode("append").json(log)


def stream_bounded(spark: SparkSession, source: str, schema, files: int, sink: str, checkpoint: str) -> int:
    """Copies arrivals with at most ``files`` of them in flight; returns the batches it took."""
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        seen.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(seen)


def isolated(rows: DataFrame, key: str, step) -> DataFrame:
    """``rows`` (key) with error: what ``step`` of the key raised, or null; one failure doesn't end the others."""

    def run(batches):
        for pdf in batches:
            said = []
            for k in pdf[key]:
                try:
                    step(int(k))
                    said.append(None)
                except Exception as e:  # noqa: BLE001  told in the row
                    said.append(str(e))
            pdf["error"] = said
            yield pdf

    return rows.select(key).mapInPandas(run, f"{key} long, error string")
