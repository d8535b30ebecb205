"""Variables of table walks: object ids as arrays, which order and slice as object ids do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import oid
from .correlate import longest_prefix


def variables(lines: DataFrame) -> DataFrame:
    """Order lines as variables: (id, line, host, oid, value)."""
    parts = F.array(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"), F.lit(6).cast("bigint"), F.col("l_suppkey") % 5, F.col("l_partkey") % 7, F.col("l_linenumber").cast("bigint"))
    return lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("host"), parts.alias("oid"), F.col("l_quantity").cast("bigint").alias("value"))


def under(rows: DataFrame, root: str) -> DataFrame:
    """The variables whose id begins with root, itself included."""
    n = root.strip(".").count(".") + 1
    return rows.where(F.slice("oid", 1, n) == oid(F.lit(root)))


def named(rows: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """rows with name, the most specific of the dictionary that begins the id (null without one), and the rest of the id as instance."""
    spark = rows.sparkSession
    nodes = spark.createDataFrame(names, "text string, name string").select(oid("text").alias("node"), "name")
    ids = rows.select("oid").distinct().withColumn("_key", F.array_join("oid", "."))
    best = longest_prefix(ids, F.col("oid"), F.broadcast(nodes), "node", "_key").select(F.col("_key"), "name", F.size("node").alias("_n"))
    keyed = rows.withColumn("_key", F.array_join("oid", "."))
    return keyed.join(best, "_key", "left").withColumn("instance", F.slice("oid", F.coalesce("_n", F.lit(0)) + 1, F.size("oid"))).drop("_key", "_n")


def interfaces(rows: DataFrame, columns: dict[int, str] | None = None) -> DataFrame:
    """(host, if_index, one column for each object): the table that the variables spell, with the index before the object's number."""
    columns = columns or {1: "in_octets", 2: "out_octets", 3: "in_errors"}
    at = lambda i: F.element_at("oid", i)
    return rows.groupBy("host", at(-2).alias("if_index")).agg(*(F.max(F.when(at(-1) == i, F.col("value"))).alias(n) for i, n in columns.items()))
