"""Streaming forms of the filters and counts: stateless filters in append mode, windows with a watermark.

A job runs over all files that are there and ends (``availableNow``); the same functions serve a job that never ends,
with another trigger. Results and checkpoints go to the folder of checkpoints, which a cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import shared_folder

def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream appends until its input ends."""
    spark = stream.sparkSession
    out = shared_folder(spark, "streams")
    job = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each type and hour; an hour is given out once the watermark has passed its end."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("events"))
    return counted.select("event_type", F.unix_micros(F.col("window.start")).alias("hour"), "events")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(hourly(events_stream(spark, sf_dir)))


def incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows through the active filter, appended to the view."""
    rows = events_stream(spark, sf_dir).where("event_type = 'error' and user_id % 3 = 1")
    return run_to_end(rows.select("event_id", "user_id"))


def state_changes(stream: DataFrame, within: int) -> DataFrame:
    """(user_id, t, event_id, state) of changes: an event in the last kept state, at most `within` microseconds after it, is dropped.

    The last kept event of each user is the state between batches; it is as large as the number of users."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        last = state.get if state.exists else None
        kept = []
        for r in rows.itertuples(index=False):
            if last is None or last[0] != r.event_type or r.t - last[1] > within:
                last = (r.event_type, int(r.t))
                kept.append((key[0], int(r.t), r.event_id, r.event_type))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=["user_id", "t", "event_id", "state"])

    rows = stream.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, t long, event_id long, state string", "state string, t long", "append", GroupStateTimeout.NoTimeout)
