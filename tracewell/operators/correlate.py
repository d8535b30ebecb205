"""Joins in time and by prefix, all on an equality that Spark can shuffle by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, keys: list[str], value: str, t: str = "t", tie: str = "id", out: str = "found") -> DataFrame:
    """left with out: the value of the last row of right with the same keys at or before its time.

    Both sides go through one window in order of time (right first at equal times), so nothing is expanded."""
    kind = right.schema[value].dataType
    a = right.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast("struct<x:int>").alias("_row"))
    row = F.struct(*left.columns)
    a = a.drop("_row")
    b = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_value"), row.alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn(out, F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", out)


def bucketed(df: DataFrame, t: str, width: int, around: tuple[int, ...] = (0,)) -> DataFrame:
    """df with _bucket: the time's bucket of that width, and its neighbours where asked for."""
    at = F.expr(f"{t} div {width}")
    if around == (0,):
        return df.withColumn("_bucket", at)
    return df.withColumn("_bucket", F.explode(F.array(*(at + i for i in around))))


def within(left: DataFrame, right: DataFrame, keys: list[str], before: int, after: int, how: str = "inner", t: str = "t", other: str = "other_t") -> DataFrame:
    """Pairs with right's time in [left's - before, left's + after]: an equality on keys and time buckets, then the exact test.

    A left row meets two buckets at most, as a bucket is as wide as the interval. left_semi and left_anti keep one
    row of left each if left has a unique id column "id"."""
    width = before + after + 1
    reach = (F.expr(f"({t} - {before}) div {width}"), F.expr(f"({t} + {after}) div {width}"))
    spread = left.withColumn("_bucket", F.explode(F.array_distinct(F.array(*reach))))
    named = right.withColumn("_bucket", F.expr(f"{other} div {width}"))
    inside = (F.col(other) >= F.col(t) - before) & (F.col(other) <= F.col(t) + after)
    pairs = spread.join(named, [*keys, "_bucket"]).where(inside).drop("_bucket")
    if how == "inner":
        return pairs
    return left.join(pairs.select("id").distinct(), "id", how)


def last_within(left: DataFrame, right: DataFrame, keys: list[str], finer: str, value: str, before: int, t: str = "t", other: str = "other_t", id_col: str = "id") -> DataFrame:
    """(id, value): of right's rows of the same keys in [left's t - before, t] the last one, with those that agree in finer as well first and the greatest value of equal times; none, no row.

    Both sides go through two windows in order of time, of one shuffle by keys and time bucket, so no pair is built. A bucket is as wide as four
    intervals and a right row stands in each that its interval reaches. Left rows of one id count as one."""
    width = 4 * (before + 1)
    reach = F.array_distinct(F.array(F.expr(f"{other} div {width}"), F.expr(f"({other} + {before}) div {width}")))
    known = lambda df, at: df.where(" and ".join(f"{c} is not null" for c in (*keys, at)))
    a = known(right, other).select(*keys, finer, F.col(other).alias("_t"), F.lit(0).alias("_side"), F.col(value), F.explode(reach).alias("_bucket"))
    b = known(left, t).select(*keys, finer, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.col(id_col), F.expr(f"{t} div {width}").alias("_bucket"))
    w = lambda *more: Window.partitionBy(*keys, "_bucket", *more).orderBy("_t", "_side", value).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("_side") == 0, F.struct("_t", value))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_any", F.last(seen, ignorenulls=True).over(w()))
    both = both.withColumn("_same", F.last(seen, ignorenulls=True).over(w(finer))).where("_side = 1")
    inside = lambda c, same: F.when(F.col(f"{c}._t") >= F.col("_t") - before, F.struct(F.lit(same).alias("same"), f"{c}._t", f"{c}.{value}"))
    found = F.coalesce(F.when(F.col(finer).isNotNull(), inside("_same", True)), inside("_any", False))
    best = both.select(id_col, found.alias("_m")).where("_m is not null").groupBy(id_col).agg(F.max("_m").alias("_m"))
    return best.select(id_col, F.col(f"_m.{value}").alias(value))


def longest_prefix(df: DataFrame, path: Column, nodes: DataFrame, node_path: str, id_col: str) -> DataFrame:
    """(id, node columns): the node whose path (an array) is the longest beginning of each row's path."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n))
    exploded = df.where(F.size(path) > 0).select(id_col, F.explode(prefixes).alias(node_path))
    hits = exploded.join(nodes, node_path)
    best = Window.partitionBy(id_col).orderBy(F.desc(F.size(node_path)))
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def roots(df: DataFrame, path: str) -> DataFrame:
    """Paths (arrays) of which no other path of the set is a beginning."""
    paths = df.select(path).distinct()
    shorter = F.expr(f"transform(sequence(1, size({path}) - 1), n -> slice({path}, 1, n))")
    longer = paths.where(F.size(path) > 1).withColumn("_short", F.explode(shorter))
    covered = longer.join(paths.select(F.col(path).alias("_short")), "_short", "left_semi").select(path).distinct()
    return paths.join(covered, path, "left_anti")
