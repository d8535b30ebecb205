"""Running values over a key's rows in order.

A window by key alone puts all rows of a key into one task, which is right for most keys: all scans of one order then share a shuffle and a sort. The rows of a hot key are also cut by a slice (a
span of time, say): each slice's own sum, greatest, first or last value is aggregated before anything moves, a window over slices hands each one what stood before it, and a second
window runs inside the slice. A hot key thus takes as many tasks as it has slices, and the window over slices sees one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def before(df: DataFrame, keys: list[str], slice_: str | None, order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """df with a column for each (kind, value): the sum, greatest, first or last value of the rows before, of the same keys; nulls are no values.

    With a slice, slices must follow one another as rows do: a row of a later slice stands later in order, and rows are stored first, as they are read twice.
    order names a row among its keys'. Without a row before, a value is null (0 for sums)."""
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = {
        "sum": lambda v, w: F.sum(v).over(w),
        "max": lambda v, w: F.max(v).over(w),
        "first": lambda v, w: F.first(v, ignorenulls=True).over(w),
        "last": lambda v, w: F.last(v, ignorenulls=True).over(w),
    }
    if slice_ is None:
        w = past(Window.partitionBy(*keys).orderBy(*order))
        return df.select("*", *((F.coalesce(over[kind](v, w), F.lit(0)) if kind == "sum" else over[kind](v, w)).alias(n) for n, (kind, v) in values.items()))
    place = F.struct(*order)
    df = stored(df.select("*", *(v.alias(f"_v_{n}") for n, (_, v) in values.items())))
    took = {
        "sum": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "first": lambda v: F.min_by(v, F.when(v.isNotNull(), place)),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), place)),
    }
    slices = df.groupBy(*keys, slice_).agg(*(took[kind](F.col(f"_v_{n}")).alias(f"_v_{n}") for n, (kind, _) in values.items()))
    across, inside = past(Window.partitionBy(*keys).orderBy(slice_)), past(Window.partitionBy(*keys, slice_).orderBy(*order))
    carried = slices.select(*keys, slice_, *(over[kind](F.col(f"_v_{n}"), across).alias(f"_c_{n}") for n, (kind, _) in values.items()))
    both = {
        "sum": lambda c, v: F.coalesce(c, F.lit(0)) + F.coalesce(v, F.lit(0)),
        "max": lambda c, v: F.greatest(c, v),
        "first": lambda c, v: F.coalesce(c, v),
        "last": lambda c, v: F.coalesce(v, c),
    }
    joined = df.join(carried, [*keys, slice_])
    kept = [c for c in df.columns if not c.startswith("_v_")]
    return joined.select(*kept, *(both[kind](F.col(f"_c_{n}"), over[kind](F.col(f"_v_{n}"), inside)).alias(n) for n, (kind, _) in values.items()))
