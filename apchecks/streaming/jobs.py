"""Structured Streaming twins of the incremental jobs.

Each job takes a streaming DataFrame and runs what is available to its end; the same functions serve
with another trigger. Progress and results live in a folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import operations
from ..sources.shared import shared_path


def finish_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-only stream to the end of its input and read what it wrote."""
    spark = stream.sparkSession
    base = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/progress")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def finish_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream to the end; every batch replaces the table."""
    spark = stream.sparkSession
    base = shared_path(spark, name)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data")

    query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{base}/progress")
    query.outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def first_copies(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Files (tenant_id, sha256, created_at, ...) without exact copies that arrive within ``delay``.

    The guarantee without a limit in time comes from the idempotent sink (`sinks.append_new`).
    """
    return files.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["tenant_id", "sha256"])


def daily_spend(calls: DataFrame, cap_micros: int, delay: str = "1 hour") -> DataFrame:
    """Spend of each tenant in tumbling days, and whether it reached the cap."""
    day = F.window("created_at", "1 day")
    out = calls.withWatermark("created_at", delay).groupBy("tenant_id", day.alias("w")).agg(F.sum("cost_micros").alias("spent_micros"), F.count("*").alias("calls"))
    return out.select("tenant_id", F.to_date("w.start").alias("day"), "spent_micros", "calls", (F.col("spent_micros") >= cap_micros).alias("cap_reached"))


_BILLED = "tenant_id string, matched_po_id long, invoice_id long, billed_minor long, billed_before_minor long, unknown_before long"
_STATE = "billed long, unknown long"


def running_billing(invoices: DataFrame) -> DataFrame:
    """What earlier invoices billed on the same order, as invoices stream in.

    ``invoices`` holds tenant_id, matched_po_id, invoice_id, created_at, status and billed_minor. The
    state of an order is two numbers. Within a batch rows are taken in received order; the batch twin is
    `matching.billed_before`.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        billed, unknown = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["created_at", "invoice_id"])
        before, open_ = [], []
        for minor, status in zip(rows["billed_minor"], rows["status"]):
            before.append(billed)
            open_.append(unknown)
            if status not in ("failed", "rejected"):
                if pd.isna(minor):
                    unknown += 1
                else:
                    billed += int(minor)
        state.update((billed, unknown))
        out = rows[["tenant_id", "matched_po_id", "invoice_id", "billed_minor"]].assign(billed_before_minor=before, unknown_before=open_)
        yield out.astype({"billed_minor": "Int64"})

    grouped = invoices.groupBy("tenant_id", "matched_po_id")
    return grouped.applyInPandasWithState(step, _BILLED, _STATE, "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table as a stream of files."""
    path = f"{folder}/{name}.parquet"
    # As a pattern, since a stream's plain path has to be a folder and a table may be one file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{name}.parque[t]")


def spend_source(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table of calls as a stream of files."""
    events = file_stream(spark, folder, name)
    cents = F.round(F.col("value") * 100).cast("long")
    return events.select(
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant_id"), F.col("ts").cast("timestamp").alias("created_at"),
        operations.cost_micros(cents, F.get_json_object("props", "$.k").cast("long"), 3_000_000, 15_000_000).alias("cost_micros"), "event_id", "props",
    )
