"""Bursts, folds, outages, sessions, timelines and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as s
from ..sources.views import LOG_SQL, log, table
from .registry import query

DAY, HOUR = 86_400_000_000, 3_600_000_000
W = f"WITH {LOG_SQL}"


@query(
    "burst_per_key",
    f"{W}, c AS (SELECT source, t, count(*) OVER (PARTITION BY source ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n FROM log WHERE severity <= 4) SELECT source, max(n) AS most, first(t ORDER BY n DESC, t) AS until, count(*) AS events FROM c GROUP BY 1 HAVING max(n) >= 2",
)
def burst_per_key(spark, sf_dir):
    return s.burst(log(spark, sf_dir).where("severity <= 4"), "source", DAY).where("most >= 2")


@query(
    "login_spread",
    f"""{W}, f AS (SELECT * FROM log WHERE program = 'error'),
a AS (SELECT address, source, max(n) AS own FROM (SELECT address, source, count(*) OVER (PARTITION BY address, source ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS n FROM f) GROUP BY 1, 2),
b AS (SELECT port, max(n) AS across FROM (SELECT port, count(*) OVER (PARTITION BY port ORDER BY t RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS n FROM f) GROUP BY 1)
SELECT DISTINCT a.address, a.source, own, across FROM a JOIN f ON a.source = f.source AND a.address = f.address JOIN b ON f.port = b.port WHERE own >= 3 OR across >= 2""",
)
def login_spread(spark, sf_dir):
    """Bursts of failures from one source, and across all sources of a port."""
    f = log(spark, sf_dir).where("program = 'error'")
    own = s.burst(f, ["address", "source"], 5 * DAY).select("address", "source", F.col("most").alias("own"))
    across = s.burst(f, "port", HOUR).select("port", F.col("most").alias("across"))
    ports = f.select("address", "source", "port").distinct()
    return own.join(ports, ["address", "source"]).join(across, "port").where("own >= 3 or across >= 2").select("address", "source", "own", "across").distinct()


@query(
    "state_fold",
    f"""{W}, r AS MATERIALIZED (SELECT source, t, id, program AS state, row_number() OVER (PARTITION BY source ORDER BY t, id) AS rn FROM log), k AS (
SELECT source, max(rn) AS n FROM r GROUP BY 1), x AS (
WITH RECURSIVE w AS (
  SELECT source, rn, t, id, state, true AS kept, t AS lt, state AS ls FROM r WHERE rn = 1
  UNION ALL
  SELECT r.source, r.rn, r.t, r.id, r.state, NOT (w.ls = r.state AND r.t - w.lt <= {2 * DAY}), CASE WHEN w.ls = r.state AND r.t - w.lt <= {2 * DAY} THEN w.lt ELSE r.t END, r.state
  FROM w JOIN r ON r.source = w.source AND r.rn = w.rn + 1)
SELECT source, t, id, state FROM w WHERE kept) SELECT * FROM x""",
)
def state_fold(spark, sf_dir):
    """State changes: an event in the last kept state, two days after it at most, is dropped."""
    rows = log(spark, sf_dir).select("source", "t", "id", F.col("program").alias("state"))
    return s.drop_repeated_states(rows, "source", "state", 2 * DAY)


@query("outage_starts", f"{W} SELECT source, t, id FROM (SELECT source, t, id, program <> 'error' AS up, lag(program <> 'error') OVER (PARTITION BY source ORDER BY t, id) AS before FROM log) WHERE NOT up AND coalesce(before, true)")
def outage_starts(spark, sf_dir):
    return s.outage_starts(log(spark, sf_dir).select("source", "t", "id", "program"), "source", F.col("program") != "error").select("source", "t", "id")


@query("down_and_stuck", f"{W} SELECT source, max(t) AS last_seen FROM log GROUP BY 1 HAVING last(program ORDER BY t, id) = 'error' AND 1706745600000000 - max(t) > {HOUR}")
def down_and_stuck(spark, sf_dir):
    last = s.last_state(log(spark, sf_dir), "source", "program")
    return last.where((F.col("program") == "error") & (F.lit(1706745600000000) - F.col("t") > HOUR)).select("source", F.col("t").alias("last_seen"))


@query(
    "steps_without_success",
    f"{W}, d AS (SELECT source, t // {DAY} AS day, program, t FROM log) SELECT source, day, count(*) AS steps FROM d a WHERE program = 'view' AND NOT EXISTS (SELECT 1 FROM d b WHERE b.source = a.source AND b.day = a.day AND b.program = 'purchase') GROUP BY 1, 2 HAVING count(*) >= 2 AND max(t) - min(t) >= {HOUR}",
)
def steps_without_success(spark, sf_dir):
    d = log(spark, sf_dir).select("source", F.expr(f"t div {DAY}").alias("day"), "program", "t")
    steps = d.where("program = 'view'").groupBy("source", "day").agg(F.count("*").alias("steps"), (F.max("t") - F.min("t")).alias("span")).where((F.col("steps") >= 2) & (F.col("span") >= HOUR))
    return steps.join(d.where("program = 'purchase'").select("source", "day"), ["source", "day"], "left_anti").select("source", "day", "steps")


@query("change_groups", f"{W}, g AS (SELECT source, CASE WHEN t - lag(t) OVER (PARTITION BY source ORDER BY t) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM log) SELECT source, count(*) AS lines, (sum(new) + 1)::BIGINT AS changes FROM g GROUP BY 1")
def change_groups(spark, sf_dir):
    return s.change_groups(log(spark, sf_dir).select("source", "t"), "source", 6 * HOUR)


@query(
    "session_idle",
    f"""{W}, g AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT source, t, id, CASE WHEN t - lag(t) OVER (PARTITION BY source ORDER BY t, id) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM log))
SELECT source, session::BIGINT AS session, min(t) AS first, max(t) AS last, count(*) AS events FROM g GROUP BY 1, 2""",
)
def session_idle(spark, sf_dir):
    return s.sessions(log(spark, sf_dir).select("source", "t", "id"), "source", 6 * HOUR)


@query(
    "restart_count",
    f"""{W}, r AS MATERIALIZED (SELECT source, t, id, program = 'signup' AS asked, row_number() OVER (PARTITION BY source ORDER BY t, id) AS rn FROM log WHERE severity <= 5),
x AS (WITH RECURSIVE w AS (
  SELECT source, rn, t AS last, CASE WHEN asked THEN t END AS req, 1::BIGINT AS n FROM r WHERE rn = 1
  UNION ALL
  SELECT r.source, r.rn, r.t, CASE WHEN r.asked THEN r.t WHEN r.t - w.last <= {6 * HOUR} OR coalesce(r.t - w.req <= {DAY}, false) THEN w.req END,
    w.n + CASE WHEN r.t - w.last <= {6 * HOUR} OR coalesce(r.t - w.req <= {DAY}, false) THEN 0 ELSE 1 END
  FROM w JOIN r ON r.source = w.source AND r.rn = w.rn + 1)
SELECT source, max(n) AS occurrences FROM w GROUP BY 1) SELECT * FROM x""",
)
def restart_count(spark, sf_dir):
    return s.fold_count(log(spark, sf_dir).where("severity <= 5"), "source", F.col("program") == "signup", 6 * HOUR, DAY)


@query(
    "planned_before",
    f"{W} SELECT source, id, program = 'signup' OR coalesce(t - max(CASE WHEN program = 'signup' THEN t END) OVER (PARTITION BY source ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {DAY}, false) AS explained FROM log",
)
def planned_before(spark, sf_dir):
    return s.planned_before(log(spark, sf_dir), "source", F.col("program") == "signup", DAY).select("source", "id", "explained")


@query(
    "timeline_slots",
    f"""{W}, b AS (SELECT min(t) AS lo, greatest(max(t) - min(t), 60000000) AS span FROM log),
x AS (SELECT program AS lane, least(greatest(floor((t - lo)::DOUBLE * 360 / span + 1e-9), 0), 359)::INT AS slot, severity, t, id FROM log, b)
SELECT lane, slot, first(severity ORDER BY severity, t, id) AS severity, first(t ORDER BY severity, t, id) AS t, first(id ORDER BY severity, t, id) AS id, count(*) AS events FROM x GROUP BY 1, 2""",
)
def timeline_slots(spark, sf_dir):
    return s.slots(log(spark, sf_dir).withColumn("lane", F.col("program")), "lane", "severity", 360)


@query(
    "timeline_union",
    f"{W} SELECT lane, count(*) AS events, min(severity) AS worst FROM (SELECT 'log ' || program AS lane, severity FROM log WHERE severity <= 4 UNION ALL SELECT 'order ' || o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 4 ELSE 6 END FROM orders) GROUP BY 1",
)
def timeline_union(spark, sf_dir):
    lines = log(spark, sf_dir).where("severity <= 4").select(F.concat(F.lit("log "), "program").alias("lane"), "severity")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), "o_orderstatus").alias("lane"), F.when(F.col("o_orderstatus") == "F", 4).otherwise(6).alias("severity"))
    return lines.unionByName(orders).groupBy("lane").agg(F.count("*").alias("events"), F.min("severity").alias("worst"))


COUNTER_SQL = """c AS (SELECT l_suppkey AS port, l_orderkey AS pos, l_linenumber AS line,
  (sum((l_extendedprice * 100)::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) * 40 % 4294967296)::BIGINT AS counter FROM lineitem),
d AS (SELECT *, lag(counter) OVER (PARTITION BY port ORDER BY pos, line) AS before FROM c)"""


def counters(spark, sf_dir):
    """A 32-bit counter of each supplier that grows with its lines and wraps."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    total = F.sum(cents).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("port"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("line"), F.pmod(total * 40, F.lit(1 << 32)).alias("counter"))
    return c.withColumn("before", F.lag("counter").over(Window.partitionBy("port").orderBy("pos", "line")))


@query(
    "counter_delta",
    f"WITH {COUNTER_SQL} SELECT port, pos, line, CASE WHEN counter >= before THEN counter - before WHEN before >= 2147483648 AND counter < 2147483648 AND counter - before + 4294967296 <= 446000000 THEN counter - before + 4294967296 END AS delta FROM d WHERE before IS NOT NULL",
)
def counter_delta(spark, sf_dir):
    return counters(spark, sf_dir).where("before is not null").select("port", "pos", "line", s.counter_delta(F.col("counter"), F.col("before"), 446_000_000).alias("delta"))


@query(
    "counter_growth",
    f"WITH {COUNTER_SQL} SELECT port, count(*) AS walks, count(*) FILTER (counter < before) AS wraps, sum(CASE WHEN counter >= before THEN counter - before WHEN before >= 2147483648 AND counter < 2147483648 THEN counter - before + 4294967296 END)::BIGINT AS growth FROM d WHERE before IS NOT NULL GROUP BY 1",
)
def counter_growth(spark, sf_dir):
    d = counters(spark, sf_dir).where("before is not null")
    return d.groupBy("port").agg(F.count("*").alias("walks"), F.count_if(F.col("counter") < F.col("before")).alias("wraps"), F.sum(s.counter_delta(F.col("counter"), F.col("before"))).alias("growth"))


@query(
    "capacity_bound",
    f"{W}, g AS (SELECT source, t - lag(t) OVER (PARTITION BY source ORDER BY t, id) AS gap, k FROM log) SELECT source, count(*) FILTER (k * 1000000 > 1000000.0 / 672 * (gap / 1000000.0) * 1.1 + 10000) AS over_bound, count(gap) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY 1",
)
def capacity_bound(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("t", "id")
    g = log(spark, sf_dir).select("source", (F.col("t") - F.lag("t").over(w)).alias("gap"), "k").where("gap is not null")
    over = F.col("k") * 1_000_000 > s.capacity(F.lit(1_000_000.0), F.col("gap") / 1_000_000.0)
    return g.groupBy("source").agg(F.count_if(over).alias("over_bound"), F.count("gap").alias("gaps"))


@query(
    "restarted",
    f"""{W}, u AS (SELECT source, t, id, (t // 10000 + source * 77777777) % 4294967296 AS up FROM log),
p AS (SELECT *, lag(up) OVER (PARTITION BY source ORDER BY t, id) AS before, (t - lag(t) OVER (PARTITION BY source ORDER BY t, id)) // 10000 AS gap FROM u)
SELECT source, id, (up < gap OR up < before) AND NOT (abs(((up - before) % 4294967296 + 4294967296) % 4294967296 - gap) <= greatest(3000, gap * 0.05) AND up < before) AS restarted FROM p WHERE before IS NOT NULL""",
)
def restarted(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("t", "id")
    ticks = F.expr("t div 10000")
    u = log(spark, sf_dir).select("source", "t", "id", F.pmod(ticks + F.col("source") * 77_777_777, F.lit(1 << 32)).alias("up"))
    u = u.withColumn("before", F.lag("up").over(w)).withColumn("gap", F.expr("t") - F.lag("t").over(w)).where("before is not null")
    return u.select("source", "id", s.restarted(F.col("up"), F.col("before"), F.expr("gap div 10000")).alias("restarted"))


@query(
    "snapshot_history",
    f"{W}, c AS (SELECT source, id, t, k, lag(k) OVER (PARTITION BY source ORDER BY t, id) AS before FROM log), d AS (SELECT * FROM c WHERE before IS NULL OR before <> k) SELECT source, id, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t DESC, id DESC) AS n FROM d) WHERE n <= 20",
)
def snapshot_history(spark, sf_dir):
    """The newest 20 snapshots of each source, those that equal the one before left out."""
    w = Window.partitionBy("source").orderBy("t", "id")
    d = log(spark, sf_dir).withColumn("before", F.lag("k").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("k")))
    newest = Window.partitionBy("source").orderBy(F.desc("t"), F.desc("id"))
    return d.withColumn("n", F.row_number().over(newest)).where("n <= 20").select("source", "id", "k")


@query("run_merge", f"{W}, g AS (SELECT source, program, t, id, CASE WHEN program = lag(program) OVER (PARTITION BY source ORDER BY t, id) THEN 0 ELSE 1 END AS new FROM log), r AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT source, run::BIGINT AS run, min(program) AS program, count(*) AS times, min(t) AS first, max(t) AS last FROM r GROUP BY 1, 2")
def run_merge(spark, sf_dir):
    """Equal consecutive events of a source as one row with how often."""
    w = Window.partitionBy("source").orderBy("t", "id")
    same = F.col("program") == F.lag("program").over(w)
    r = log(spark, sf_dir).withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("source", "run").agg(F.min("program").alias("program"), F.count("*").alias("times"), F.min("t").alias("first"), F.max("t").alias("last"))
