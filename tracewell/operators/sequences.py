"""Operators on events in order of time, by key. Times are microseconds (bigint)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SECOND = 1_000_000


def _by(keys, order="t"):
    keys = [keys] if isinstance(keys, str) else list(keys)
    return keys, Window.partitionBy(*keys).orderBy(order)


def burst(df: DataFrame, keys, window: int, t: str = "t") -> DataFrame:
    """Each key's most events in any window (inclusive, microseconds), and the earliest end of such a window."""
    keys, w = _by(keys, t)
    counted = df.withColumn("_n", F.count("*").over(w.rangeBetween(-window, 0)))
    return counted.groupBy(*keys).agg(F.max("_n").alias("most"), F.max_by(t, F.struct("_n", -F.col(t))).alias("until"), F.count("*").alias("events"))


def folded(df: DataFrame, keys: list[str], order: list[str], step, schema) -> DataFrame:
    """What step gives over each key's rows in order, one row at a time; a task holds the state of one key, and rows only of a batch.

    step(state, row) gives (state, rows out); the state of a new key is None, and after a key's last row, step(state, None) is asked once more."""

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                own = tuple(row[k] for k in keys)
                if own != key:
                    if key is not None:
                        out += [(*key, *r) for r in step(state, None)[1]]
                    key, state = own, None
                state, rows = step(state, row)
                out += [(*key, *r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * len(types), types)], names=[f.name for f in schema.fields])
        if key is not None:
            last = [(*key, *r) for r in step(state, None)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*last)) or [()] * len(types), types)], names=[f.name for f in schema.fields])

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def drop_repeated_states(df: DataFrame, keys, state: str, within: int, t: str = "t", tie: str = "id") -> DataFrame:
    """Drops an event whose state is that of the last kept event, if not more than `within` after it.

    What is kept depends on what was kept before, so it is a fold over each key's events."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df.select(*keys, t, tie, state)

    def step(last, row):
        if row is None or last is not None and last[1] == row[state] and row[t] - last[0] <= within:
            return last, []
        return (row[t], row[state]), [(row[t], row[tie], row[state])]

    return folded(rows, keys, [t, tie], step, rows.schema)


def outage_starts(df: DataFrame, keys, up: Column, t: str = "t", tie: str = "id") -> DataFrame:
    """Events that are down and whose predecessor is not."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    before = F.lag("_up").over(Window.partitionBy(*keys).orderBy(t, tie))
    return df.withColumn("_up", up).withColumn("_before", before).where(~F.col("_up") & (F.col("_before").isNull() | F.col("_before"))).drop("_up", "_before")


def last_state(df: DataFrame, keys, state: str, t: str = "t", tie: str = "id") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = F.struct(t, tie)
    return df.groupBy(*keys).agg(F.max_by(state, order).alias(state), F.max(t).alias(t))


def change_groups(df: DataFrame, keys, gap: int, t: str = "t") -> DataFrame:
    """Lines and changes of each key: a gap longer than `gap` starts a new change."""
    keys, w = _by(keys, t)
    fresh = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", fresh).groupBy(*keys).agg(F.count("*").alias("lines"), (F.sum("_new") + 1).alias("changes"))


def sessions(df: DataFrame, keys, idle: int, t: str = "t", tie: str = "id") -> DataFrame:
    """(keys, session, first, last, events): spells of activity without a gap longer than idle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(t, tie)
    fresh = F.when(F.col(t) - F.lag(t).over(w) > idle, 1).otherwise(0)
    numbered = df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("events"))


def fold_count(df: DataFrame, keys, request: Column, after_any: int, after_request: int, t: str = "t", tie: str = "id") -> DataFrame:
    """Occurrences of each key, where a line soon after the last line, or after a request, belongs to the same one."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df.select(*keys, F.col(t).alias("_t"), F.col(tie).alias("_tie"), F.coalesce(request, F.lit(False)).alias("_asked"))

    def step(state, row):
        n, last, asked = state or (0, None, None)
        if row is None:
            return None, [(n,)]
        now = row["_t"]
        same = last is not None and now - last <= after_any or asked is not None and now - asked <= after_request
        return (n + (not same), now, now if row["_asked"] else asked if same else None), []

    return folded(rows, keys, ["_t", "_tie"], step, T.StructType([*(rows.schema[k] for k in keys), T.StructField("occurrences", T.LongType())]))


def planned_before(df: DataFrame, keys, planned: Column, within: int, t: str = "t", tie: str = "id") -> DataFrame:
    """df with explained: the event is planned, or a planned one stands at most `within` before it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(planned, F.col(t))).over(w)
    return df.withColumn("explained", planned | F.coalesce(F.col(t) - last <= within, F.lit(False)))


def slots(df: DataFrame, lane: str, severity: str, count: int, t: str = "t", tie: str = "id", least_span: int = 60 * SECOND) -> DataFrame:
    """(lane, slot, ...): the worst event (least severity) of each lane and slot of the whole span; ties go to the earliest."""
    span = df.agg(F.min(t).alias("_lo"), F.greatest(F.max(t) - F.min(t), F.lit(least_span)).alias("_span"))
    placed = df.crossJoin(F.broadcast(span))  # one row
    slot = F.least(F.greatest(F.floor((F.col(t) - F.col("_lo")).cast("double") * count / F.col("_span") + F.lit(1e-9)), F.lit(0)), F.lit(count - 1)).cast("int")
    worst = F.min(F.struct(F.col(severity), F.col(t), F.col(tie)))
    out = placed.withColumn("slot", slot).groupBy(lane, "slot").agg(worst.alias("_w"), F.count("*").alias("events"))
    return out.select(lane, "slot", F.col(f"_w.{severity}").alias(severity), F.col(f"_w.{t}").alias(t), F.col(f"_w.{tie}").alias(tie), "events")


def counter_delta(now: Column, before: Column, limit: Column | int | None = None, bits: int = 32) -> Column:
    """Growth of an unsigned counter. A fall is a wrap only from the upper to the lower half, and within limit; else null (cleared)."""
    half, whole = 1 << (bits - 1), 1 << bits
    wrapped = now - before + F.lit(whole)
    ok = (before >= half) & (now < half)
    if limit is not None:
        ok = ok & (wrapped <= limit)
    return F.when(now >= before, now - before).when(ok, wrapped)


def capacity(speed: Column, seconds: Column) -> Column:
    """The most frames that a port of that speed passes in so many seconds, with a tenth and 10,000 to spare."""
    return speed / 672 * seconds * 1.1 + 10_000


def restarted(uptime: Column, before: Column, gap_ticks: Column) -> Column:
    """Whether a device restarted between two walks: its uptime is shorter than the gap or fell, unless the 32-bit clock of ticks wrapped."""
    wrapped = F.abs(F.pmod(uptime - before, F.lit(1 << 32)) - gap_ticks) <= F.greatest(F.lit(3000), gap_ticks * 0.05)
    return ((uptime < gap_ticks) | (uptime < before)) & ~(wrapped & (uptime < before))


def upper_median(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, median): the upper of the two middle values, from counts of each value, so that no task gathers a key's values."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto, all_ = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value)), F.sum("_n").over(Window.partitionBy(*keys))
    picked = counted.withColumn("_upto", upto).withColumn("_all", all_).where(F.col("_upto") > F.floor(F.col("_all") / 2))
    return picked.groupBy(*keys).agg(F.min(value).alias("median"))


def sequence_before(a: Column, b: Column) -> Column:
    """a stands before b in 32-bit modular order."""
    return (F.pmod(b - a, F.lit(1 << 32)) < (1 << 31)) & (a != b)
