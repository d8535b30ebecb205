"""The driver's tables seen as an operations log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
#: The severity that an event's type stands for in the log view.
TYPE_SEVERITY = {"error": 3, "purchase": 4, "signup": 5, "view": 6, "click": 7}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines: one row per event, with typed columns, an ordered list of fields, and the raw line."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    severity = F.coalesce(*(F.when(F.col("event_type") == t, s) for t, s in TYPE_SEVERITY.items()), F.lit(6))
    k = F.get_json_object("props", "$.k").cast("int")
    address = F.concat(F.lit("10."), (user % 4).cast("string"), F.lit("."), (user % 16).cast("string"), F.lit("."), (user % 250).cast("string"))
    rows = e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("received"),
        micros(F.col("ts")).alias("t"),
        address.alias("address"),
        F.concat(F.lit("sw"), user.cast("string")).alias("host"),
        user.alias("source"),
        F.col("event_type").alias("program"),
        severity.cast("int").alias("severity"),
        (user % 24).cast("int").alias("facility"),
        (F.lit(514) + user % 7).cast("int").alias("port"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 1000).cast("string")).alias("pid"),
        F.col("value"),
        k.alias("k"),
    )
    field = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    rows = rows.withColumn("fields", F.array(field("k", F.col("k")), field("srcip", F.col("address")), field("ifIndex.3", F.col("id") % 48), field("user", F.concat(F.lit("u"), F.col("source").cast("string")))))
    message = F.concat(F.lit("k="), F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit(" srcip="), F.col("address"), F.lit(" user=u"), F.col("source").cast("string"))
    rows = rows.withColumn("message", message)
    tag = F.concat(F.col("program"), F.when(F.col("pid").isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.col("pid"), F.lit("]"))))
    head = F.concat(F.lit("<"), (F.col("facility") * 8 + F.col("severity")).cast("string"), F.lit(">"), F.date_format("received", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), F.col("host"), F.lit(" "))
    return rows.withColumn("raw", F.concat(head, tag, F.lit(": "), F.col("message")))


#: The same view for the checking SQL: a common table expression.
LOG_SQL = """log AS (
  SELECT event_id AS id, ts AS received, epoch_us(ts) AS t,
    '10.' || (user_id % 4) || '.' || (user_id % 16) || '.' || (user_id % 250) AS address,
    'sw' || user_id AS host, user_id AS source, event_type AS program,
    CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 WHEN 'view' THEN 6 WHEN 'click' THEN 7 ELSE 6 END AS severity,
    (user_id % 24)::INT AS facility, (514 + user_id % 7)::INT AS port,
    CASE WHEN event_id % 5 <> 0 THEN (event_id % 1000)::VARCHAR END AS pid,
    value, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INT AS k
  FROM events)"""
