"""Progress of keyed tasks: the fold in batch form and as a streaming job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TERMINAL = ("completed", "failed")
#: Event types of the events table as states of a task.
STATES = {"signup": "pending", "view": "chunking", "click": "embedding", "purchase": "completed", "error": "failed"}


def state_of(event_type: Column) -> Column:
    return F.coalesce(*[F.when(event_type == k, F.lit(v)) for k, v in STATES.items()])


def upsert(events: DataFrame, keys: list[str], order: list[str], always: list[str], if_set: list[str]) -> DataFrame:
    """The state after all events: ``always`` columns of the last event, ``if_set`` columns of the last that sets them."""
    place = F.struct(*order)
    return events.groupBy(*keys).agg(
        *[F.max_by(c, place).alias(c) for c in always], *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in if_set], F.min(F.col(order[0])).alias("first_at"), F.max(F.col(order[0])).alias("last_at"), F.count(F.lit(1)).alias("n_events")
    )


def progress_of(events: DataFrame) -> DataFrame:
    """The state of each user's task in the events table."""
    rows = events.select("user_id", "ts", "event_id", state_of(F.col("event_type")).alias("status"), F.least(F.col("value"), F.lit(100.0)).alias("pct"))
    return upsert(rows, ["user_id"], ["ts", "event_id"], ["status", "pct"], [])


def all_done(states: DataFrame) -> DataFrame:
    """Whether every task has ended; false without tasks."""
    return states.agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("status").isin(*TERMINAL)).alias("n_ended"), (F.coalesce(F.every(F.col("status").isin(*TERMINAL)), F.lit(False))).alias("all_done"))


def until_ended(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a stream of each key sends: all events up to the first that ends it."""
    by = W.partitionBy(*keys).orderBy(*order)
    before = F.sum(F.when(F.col("status").isin(*TERMINAL), 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("_ended", F.coalesce(before, F.lit(0))).where("_ended = 0").drop("_ended")


def start_progress(events: DataFrame, name: str, checkpoint: str, watermark: str | None = None) -> StreamingQuery:
    """Keep the progress of a stream of events in the memory table ``name`` until its input ends."""
    rows = events if watermark is None else events.withWatermark("ts", watermark)
    out = progress_of(rows)
    return out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window; late rows beyond the watermark are dropped when streamed."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
