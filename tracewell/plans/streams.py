"""Streams, run to the end of what the tables hold."""

from __future__ import annotations

from ..streaming import jobs
from .registry import query


@query("stream_hourly", "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour, count(*) AS events FROM events GROUP BY 1, 2 HAVING epoch_us(date_trunc('hour', min(ts))) + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)")
def stream_hourly(spark, sf_dir):
    return jobs.hourly_counts(spark, sf_dir)


@query("stream_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 1")
def stream_filter(spark, sf_dir):
    return jobs.incremental_filter(spark, sf_dir)


def _state_sql() -> str:
    from .registry import SQL

    return f"SELECT source AS user_id, t, id AS event_id, state FROM ({SQL['state_fold']})"


@query("stream_state_changes", _state_sql())
def stream_state_changes(spark, sf_dir):
    return jobs.run_to_end(jobs.state_changes(jobs.events_stream(spark, sf_dir), 2 * 86_400_000_000))
