"""Counts, shares, medians and tops over the log view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.sequences import upper_median
from ..sources.views import LOG_SQL, log, table
from .registry import query

DAY, HOUR, MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000
W = f"WITH {LOG_SQL}"


@query(
    "source_stats",
    f"{W} SELECT source, count(*) AS lines, {', '.join(f'count(*) FILTER (severity = {i}) AS s{i}' for i in range(8))}, min(t) AS first, max(t) AS last, last(host ORDER BY t, id) AS host FROM log GROUP BY source",
)
def source_stats(spark, sf_dir):
    by = [F.count_if(F.col("severity") == i).alias(f"s{i}") for i in range(8)]
    return log(spark, sf_dir).groupBy("source").agg(F.count("*").alias("lines"), *by, F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("host", F.struct("t", "id")).alias("host"))


@query("severity_histogram", f"{W} SELECT severity, count(*) AS lines FROM log GROUP BY 1")
def severity_histogram(spark, sf_dir):
    return log(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("lines"))


@query("problem_count", f"{W} SELECT count(*) FILTER (severity <= 3 AND t >= 1705276800000000) AS problems, count(*) AS lines FROM log")
def problem_count(spark, sf_dir):
    return log(spark, sf_dir).agg(F.count_if((F.col("severity") <= 3) & (F.col("t") >= 1705276800000000)).alias("problems"), F.count("*").alias("lines"))


@query("top_sources", f"{W} SELECT source, count(*) AS lines FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_sources(spark, sf_dir):
    return log(spark, sf_dir).groupBy("source").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "source").limit(8)


@query("rate_per_hour", f"{W} SELECT t // {HOUR} AS hour, count(*) AS lines FROM log GROUP BY 1")
def rate_per_hour(spark, sf_dir):
    return log(spark, sf_dir).groupBy(F.expr(f"t div {HOUR}").alias("hour")).agg(F.count("*").alias("lines"))


@query(
    "rate_smoothed",
    f"{W}, h AS (SELECT source % 8 AS part, t // {HOUR} AS hour, count(*) AS n FROM log GROUP BY 1, 2) SELECT part, hour, round(avg(n) OVER (PARTITION BY part ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rate FROM h",
)
def rate_smoothed(spark, sf_dir):
    hours = log(spark, sf_dir).groupBy((F.col("source") % 8).alias("part"), F.expr(f"t div {HOUR}").alias("hour")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("part").orderBy("hour").rowsBetween(-2, 0)
    return hours.select("part", "hour", F.round(F.avg("n").over(w), 6).alias("rate"))


@query(
    "error_spike",
    f"""{W}, d AS (SELECT source, t // {DAY} AS day, count(*) AS n FROM log WHERE severity <= 4 GROUP BY 1, 2),
s AS (SELECT source, max(n) AS peak, min(day) FILTER (n = m) AS peak_day, sum(n) AS total, max(day) - min(day) + 1 AS span FROM (SELECT *, max(n) OVER (PARTITION BY source) AS m FROM d) GROUP BY 1)
SELECT source, peak::BIGINT AS peak, peak_day, span::BIGINT AS span, round((total - peak) / greatest(span - 1, 1), 6) AS usual FROM s WHERE span >= 10 AND peak >= 3 * greatest((total - peak) / greatest(span - 1, 1), 0.5)""",
)
def error_spike(spark, sf_dir):
    """Sources whose busiest day of errors is three times the usual day; days without errors count as 0, ties go to the earliest."""
    days = log(spark, sf_dir).where("severity <= 4").groupBy("source", F.expr(f"t div {DAY}").alias("day")).agg(F.count("*").alias("n"))
    s = days.groupBy("source").agg(F.max("n").alias("peak"), F.max_by("day", F.struct("n", -F.col("day"))).alias("peak_day"), F.sum("n").alias("total"), (F.max("day") - F.min("day") + 1).alias("span"))
    usual = (F.col("total") - F.col("peak")) / F.greatest(F.col("span") - 1, F.lit(1))
    found = s.withColumn("usual", usual).where((F.col("span") >= 10) & (F.col("peak") >= 3 * F.greatest(F.col("usual"), F.lit(0.5))))
    return found.select("source", "peak", "peak_day", "span", F.round("usual", 6).alias("usual"))


@query(
    "flood_hours",
    f"{W}, h AS (SELECT source % 4 AS part, t // {HOUR} AS hour, count(*) AS n FROM log GROUP BY 1, 2) SELECT part, count(*) AS hours, max(n) AS peak FROM h WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 5",
)
def flood_hours(spark, sf_dir):
    hours = log(spark, sf_dir).groupBy((F.col("source") % 4).alias("part"), F.expr(f"t div {HOUR}").alias("hour")).agg(F.count("*").alias("n"))
    return hours.where("n >= 5").groupBy("part").agg(F.count("*").alias("hours"), F.max("n").alias("peak")).where("hours >= 5")


@query("upper_median", "SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1")
def median(spark, sf_dir):
    return upper_median(table(spark, sf_dir, "events"), "user_id", "value")


@query(
    "argmax_tie",
    f"{W}, c AS (SELECT source, program, count(*) AS n FROM log GROUP BY 1, 2) SELECT source, first(program ORDER BY n DESC, program) AS program, max(n) AS lines FROM c GROUP BY 1",
)
def argmax_tie(spark, sf_dir):
    """Each source's commonest program; ties go to the first by name."""
    c = log(spark, sf_dir).groupBy("source", "program").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.min_by("program", F.struct(-F.col("n"), F.col("program"))).alias("program"), F.max("n").alias("lines"))


@query(
    "failure_share",
    f"{W} SELECT port, count(*) AS queries, count(*) FILTER (severity <= 4) AS failed, round(count(*) FILTER (severity <= 4) / count(*), 6) AS share FROM log GROUP BY 1 HAVING count(*) >= 10",
)
def failure_share(spark, sf_dir):
    s = log(spark, sf_dir).groupBy("port").agg(F.count("*").alias("queries"), F.count_if(F.col("severity") <= 4).alias("failed"))
    return s.where("queries >= 10").withColumn("share", F.round(F.col("failed") / F.col("queries"), 6))


@query(
    "worst_day",
    f"""{W}, d AS (SELECT port, t // {DAY} AS day, count(*) AS n, count(*) FILTER (severity <= 4) AS bad FROM log GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT port, first(day ORDER BY bad / n DESC, day) AS day, round(max(bad / n), 6) AS share FROM d GROUP BY 1""",
)
def worst_day(spark, sf_dir):
    d = log(spark, sf_dir).groupBy("port", F.expr(f"t div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") <= 4).alias("bad")).where("n >= 10")
    d = d.withColumn("share", F.col("bad") / F.col("n"))
    return d.groupBy("port").agg(F.min_by("day", F.struct(-F.col("share"), F.col("day"))).alias("day"), F.round(F.max("share"), 6).alias("share"))


@query("distinct_claims", f"{W} SELECT port, count(DISTINCT source) AS claims, list_sort(list(DISTINCT source))[1:3] AS first_three FROM log GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def distinct_claims(spark, sf_dir):
    """Ports that more than one source claims, with the first three."""
    pairs = log(spark, sf_dir).select("port", "source").distinct()
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("port").orderBy("source"))).where("_r <= 3")
    three = first.groupBy("port").agg(F.array_sort(F.collect_list("source")).alias("first_three"))
    return pairs.groupBy("port").agg(F.count("*").alias("claims")).where("claims >= 2").join(three, "port")


@query("summary", f"{W} SELECT count(*) AS lines, count(DISTINCT host) AS devices, count(DISTINCT address) AS addresses, min(t) AS first, max(t) AS last, count(*) FILTER (pid IS NULL) AS without_pid FROM log")
def summary(spark, sf_dir):
    return log(spark, sf_dir).agg(F.count("*").alias("lines"), F.countDistinct("host").alias("devices"), F.countDistinct("address").alias("addresses"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("pid").isNull()).alias("without_pid"))


@query("top_per_key", f"{W}, c AS (SELECT program, source, count(*) AS n FROM log GROUP BY 1, 2) SELECT program, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY n DESC, source) AS rank FROM c) WHERE rank <= 3")
def top_per_key(spark, sf_dir):
    c = log(spark, sf_dir).groupBy("program", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("program").orderBy(F.desc("n"), "source")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("byte_counters", "SELECT l_suppkey, count(*) AS packets, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS to_server, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS to_client FROM lineitem GROUP BY 1")
def byte_counters(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    back = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("packets"), F.sum(F.when(back, q).otherwise(0)).alias("to_server"), F.sum(F.when(~back, q).otherwise(0)).alias("to_client"))


@query("lane_counters", f"{W} SELECT host, count(*) AS events, count(*) FILTER (severity <= 4) AS problems, min(severity) AS worst, min(t) AS first, max(t) AS last FROM log GROUP BY 1")
def lane_counters(spark, sf_dir):
    return log(spark, sf_dir).groupBy("host").agg(F.count("*").alias("events"), F.count_if(F.col("severity") <= 4).alias("problems"), F.min("severity").alias("worst"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("document_stats", "SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY 1, 2")
def document_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query(
    "clock_skew",
    "SELECT o_orderpriority, list_sort(list(d))[count(*) // 2 + 1] AS median_days, count(*) AS samples FROM (SELECT o_orderpriority, abs(date_diff('day', o_orderdate, l_shipdate))::BIGINT AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1 HAVING count(*) >= 3",
)
def clock_skew(spark, sf_dir):
    """The upper median distance between two clocks; a histogram of whole days keeps the group's state small."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    d = j.groupBy("o_orderpriority", F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))).cast("bigint").alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("d")
    whole = Window.partitionBy("o_orderpriority")
    d = d.withColumn("upto", F.sum("n").over(w)).withColumn("samples", F.sum("n").over(whole))
    picked = d.where((F.col("samples") >= 3) & (F.col("upto") > F.floor(F.col("samples") / 2)))
    return picked.groupBy("o_orderpriority").agg(F.min("d").alias("median_days"), F.max("samples").alias("samples"))
