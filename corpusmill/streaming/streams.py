"""Structured Streaming forms of ingest, leases, claims and status."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import _written, shared_dir

LEASE_SECONDS = 900


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """T1. A stream over the files of a parquet table, with the table's own schema."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path.removeprefix("file://")):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def first_texts(nodes: DataFrame) -> DataFrame:
    """T2. Keep the first arrival of every (run_id, text_digest). Batch R16 keeps the first crawl time instead; with input in
    crawl order both agree."""
    return nodes.dropDuplicates(["run_id", "text_digest"])


def lease_spans(beats: DataFrame, key: str, time: str, lease_seconds: int = LEASE_SECONDS, late: str | None = None) -> DataFrame:
    """T3. Spans during which a lease was held: heartbeats no more than the lease apart; a span ends one lease after its last.

    A stream without `late` has no watermark: run in complete mode, it gives the spans of all heartbeats in any order, open
    ones included, as the batch does. With `late` (append mode) closed spans only, and heartbeats later than that are lost.
    """
    w = F.session_window(time, f"{lease_seconds} seconds")
    src = beats.withWatermark(time, late) if beats.isStreaming and late else beats
    return src.groupBy(key, w.alias("span")).agg(F.count("*").alias("beats")).select(key, F.col("span.start").alias("held_from"), F.col("span.end").alias("held_until"), "beats")


def claim_once(claims: DataFrame, key: str, time: str, expiry: str | None = None) -> DataFrame:
    """T5, S26. The first claim of every key; a repeat within the expiry is refused, however late it comes where there is none.

    With an expiry, claims further behind the newest than that are lost, so the input has to be in order up to it.
    """
    if expiry is None:
        return claims.dropDuplicates([key])
    return claims.withWatermark(time, expiry).dropDuplicatesWithinWatermark([key])


def latest_status(statuses: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """T6. The status with the newest time of every key, whatever order they arrive in."""
    return statuses.groupBy(key).agg(F.max_by(value, F.struct(F.col(time), F.col(value))).alias(value), F.max(time).alias(time))


def run_available(stream: DataFrame, tag: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """T4. Run a stream over what is there (trigger availableNow) into a table of the shared folder and read it.

    Batches are written under their number, so a batch that is repeated after a failure replaces itself. In complete
    mode the last batch is the result. On a cluster, run with processingTime='300 seconds' instead for the cadence.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/mill-{tag}-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(df: DataFrame, number: int) -> None:
        (each or (lambda d, n: None))(df, number)
        df.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    _written.append((spark, base))
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).parquet(*[f"{base}/rows/batch={n}" for n in (last if mode == "append" else last[-1:])])
    return rows
