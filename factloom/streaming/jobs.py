"""Structured Streaming jobs: deduplication under a watermark, windows, sessions, and an upsert that keeps its state in the state store."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import shared_folder


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over parquet files, with event time as `at` (a timestamp in the session's zone)."""
    schema = spark.read.parquet(path).schema
    files = path if path.endswith("/") else f"{path}*"  # a pattern, because a stream reads no single file
    return spark.readStream.schema(schema).parquet(files).withColumn("at", F.col("ts").cast("timestamp"))


def deduplicate(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once; a repeat may come up to `late` after the first."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, keys: list[str], width: str, late: str) -> DataFrame:
    """Closed tumbling windows and their counts; state is kept until the watermark passes a window's end."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), *keys).agg(F.count("*").alias("events"), F.max("value").alias("most"))


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("events"))


def new_home(spark: SparkSession, name: str) -> str:
    """A folder for a run of its own."""
    return f"{shared_folder(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there, into a table in the shared folder, and read that table."""
    home = new_home(stream.sparkSession, name)
    run = stream.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).outputMode(mode).format("parquet").option("path", f"{home}/table").start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/table")


def upsert_stream(stream: DataFrame, keys: list[str], version: str, home: str) -> DataFrame:
    """Keep-latest state of a stream: for each key its row of the greatest version, of equal ones the greatest row.

    home: a folder that executors share, which holds the checkpoint, with the state, and what each batch changed; a later
    run on the same home reads new input only and goes on from that state. The state store keeps a row for each key; a batch
    writes the keys that it changed to a table of its own, so a batch that runs again writes the same one again. Returns
    the latest row of each key over all batches.
    """
    spark = stream.sparkSession
    others = [c for c in stream.columns if c not in (*keys, version)]
    latest = stream.groupBy(*keys).agg(F.max(F.struct(version, *others)).alias("_row"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/changes/batch={number}")

    run = latest.writeStream.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).outputMode("update").foreachBatch(write).start()
    run.awaitTermination()
    changes = spark.read.schema(latest.schema).parquet(f"{home}/changes")
    return changes.groupBy(*keys).agg(F.max("_row").alias("_row")).select(*keys, "_row.*").select(*stream.columns)
