"""As-of, interval, anti, prefix and outer joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import correlate as c
from ..sources.views import LOG_SQL, log, micros, table
from .registry import query

DAY, HOUR = 86_400_000_000, 3_600_000_000
W = f"WITH {LOG_SQL}"


@query("asof_last_open", f"{W}, v AS (SELECT source, t, arg_max(id, id) AS id FROM log WHERE program = 'view' GROUP BY 1, 2) SELECT p.id, v.id AS found FROM (SELECT * FROM log WHERE program = 'purchase') p ASOF LEFT JOIN v ON p.source = v.source AND p.t >= v.t")
def asof_last_open(spark, sf_dir):
    """Each purchase with the source's last view before it."""
    rows = log(spark, sf_dir)
    views = rows.where("program = 'view'").groupBy("source", "t").agg(F.max("id").alias("opened"))
    return c.last_before(rows.where("program = 'purchase'").select("source", "t", "id"), views, ["source"], "opened").select("id", "found")


@query("interval_join", f"{W} SELECT a.id, b.id AS other FROM log a JOIN log b ON a.source = b.source AND b.t BETWEEN a.t - {HOUR} AND a.t + {6 * HOUR} WHERE a.program = 'error' AND b.program = 'click'")
def interval_join(spark, sf_dir):
    rows = log(spark, sf_dir)
    right = rows.where("program = 'click'").select("source", F.col("t").alias("other_t"), F.col("id").alias("other"))
    return c.within(rows.where("program = 'error'").select("source", "t", "id"), right, ["source"], HOUR, 6 * HOUR).select("id", "other")


@query("anti_interval", f"{W}, e AS (SELECT max(t) AS stop FROM log) SELECT a.id FROM log a, e WHERE a.program = 'view' AND a.t <= stop - {2 * DAY} AND NOT EXISTS (SELECT 1 FROM log b WHERE b.program = 'click' AND b.source = a.source AND b.t BETWEEN a.t AND a.t + {2 * DAY}) AND NOT EXISTS (SELECT 1 FROM log b WHERE b.program = 'purchase' AND b.source = a.source AND b.t BETWEEN a.t AND a.t + {2 * DAY})")
def anti_interval(spark, sf_dir):
    """Views that neither a click nor a purchase answers in time; the last of the log are not settled yet."""
    rows = log(spark, sf_dir).select("source", "t", "id", "program")
    end = rows.agg(F.max("t").alias("stop"))
    asked = rows.where("program = 'view'").crossJoin(F.broadcast(end)).where(F.col("t") <= F.col("stop") - 2 * DAY).select("source", "t", "id")
    for kind in ("click", "purchase"):
        answers = rows.where(F.col("program") == kind).select("source", F.col("t").alias("other_t"))
        asked = c.within(asked, answers, ["source"], 0, 2 * DAY, "left_anti")
    return asked.select("id")


@query(
    "nearest_prior",
    f"""{W}, p AS (SELECT a.id, b.id AS cause, row_number() OVER (PARTITION BY a.id ORDER BY (a.host = b.host) DESC, b.t DESC, b.id DESC) AS n FROM log a JOIN log b ON a.port = b.port AND b.t BETWEEN a.t - {HOUR} AND a.t WHERE a.program = 'error' AND b.program = 'signup')
SELECT id, cause FROM p WHERE n = 1""",
)
def nearest_prior(spark, sf_dir):
    """The nearest change in the hour before each error of the same group, one of the same device first."""
    rows = log(spark, sf_dir)
    changes = rows.where("program = 'signup'").select("port", "host", F.col("t").alias("other_t"), F.col("id").alias("cause"))
    return c.last_within(rows.where("program = 'error'").select("port", "t", "id", "host"), changes, ["port"], "host", "cause", HOUR)


@query(
    "interval_left_max",
    f"{W} SELECT a.id, max(b.id * 1) FILTER (b.t = (SELECT max(x.t) FROM log x WHERE x.program = 'click' AND x.source = a.source AND x.t BETWEEN a.t - {6 * HOUR} AND a.t + {HOUR})) AS reason FROM log a LEFT JOIN log b ON b.program = 'click' AND b.source = a.source AND b.t BETWEEN a.t - {6 * HOUR} AND a.t + {HOUR} WHERE a.program = 'error' GROUP BY a.id",
)
def interval_left_max(spark, sf_dir):
    """Each error with the last click around it, null without one."""
    rows = log(spark, sf_dir)
    errors = rows.where("program = 'error'").select("source", "t", "id")
    clicks = rows.where("program = 'click'").select("source", F.col("t").alias("other_t"), F.col("id").alias("reason"))
    best = c.within(errors, clicks, ["source"], 6 * HOUR, HOUR).groupBy("id").agg(F.max(F.struct("other_t", "reason")).alias("m"))
    return errors.select("id").join(best, "id", "left").select("id", F.col("m.reason").alias("reason"))


@query("suppressed_by_later", f"{W}, f AS (SELECT source, max(t) AS last FROM log WHERE program = 'error' GROUP BY 1) SELECT source, last FROM f WHERE NOT EXISTS (SELECT 1 FROM log u WHERE u.source = f.source AND u.program = 'purchase' AND u.t >= f.last)")
def suppressed_by_later(spark, sf_dir):
    rows = log(spark, sf_dir)
    failed = rows.where("program = 'error'").groupBy("source").agg(F.max("t").alias("last"))
    up = rows.where("program = 'purchase'").groupBy("source").agg(F.max("t").alias("up"))
    return failed.join(up, "source", "left").where(F.col("up").isNull() | (F.col("up") < F.col("last"))).select("source", "last")


@query("failure_then_success", f"{W}, f AS (SELECT source, port, min(t) AS first FROM log WHERE program = 'error' GROUP BY 1, 2) SELECT f.source, min(s.t) AS success FROM f LEFT JOIN log s ON s.source = f.source AND s.program = 'purchase' AND s.t >= f.first GROUP BY 1")
def failure_then_success(spark, sf_dir):
    rows = log(spark, sf_dir)
    first = rows.where("program = 'error'").groupBy("source").agg(F.min("t").alias("first"))
    won = rows.where("program = 'purchase'").select("source", F.col("t").alias("ok"))
    j = first.join(won, "source", "left")
    return j.groupBy("source").agg(F.min(F.when(F.col("ok") >= F.col("first"), F.col("ok"))).alias("success"))


@query(
    "request_response",
    "WITH r AS (SELECT conv_id, turn, role, length(text) AS n, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, n::BIGINT AS n, CASE WHEN next_role = 'assistant' THEN answer END::BIGINT AS answer FROM r WHERE role = 'user'",
)
def request_response(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("bigint")
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("n"), F.lead("role").over(w).alias("next_role"), F.lead(n).over(w).alias("next_n"))
    return r.where("role = 'user'").select("conv_id", "turn", "n", F.when(F.col("next_role") == "assistant", F.col("next_n")).alias("answer"))


@query(
    "retransmissions",
    f"{W}, g AS (SELECT source, program, t, id, lag(t) OVER (PARTITION BY source, program ORDER BY t, id) AS before FROM log) SELECT source, program, count(*) AS sent, count(*) FILTER (t - before <= {6 * HOUR}) AS again FROM g GROUP BY 1, 2",
)
def retransmissions(spark, sf_dir):
    """Requests that repeat the one before of the same key in time."""
    w = Window.partitionBy("source", "program").orderBy("t", "id")
    g = log(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(w))
    return g.groupBy("source", "program").agg(F.count("*").alias("sent"), F.count_if(F.col("gap") <= 6 * HOUR).alias("again"))


@query(
    "outer_join_pivot",
    """WITH a AS (SELECT l_suppkey AS k, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS r FROM lineitem GROUP BY 1),
b AS (SELECT s_suppkey AS k, s_name, s_nationkey FROM supplier)
SELECT coalesce(a.k, b.k) AS idx, s_name, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(s_nationkey::BIGINT, a + n + r) AS shown FROM a FULL JOIN b ON a.k = b.k""",
)
def outer_join_pivot(spark, sf_dir):
    """Two tables of one index, columns from rows on one side, joined with either side missing."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("idx")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    a = a.select("idx", *(F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in "ANR"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), "s_name", "s_nationkey")
    j = a.join(b, "idx", "full")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in "anr"]
    return j.select("idx", "s_name", *zero, F.coalesce(F.col("s_nationkey").cast("bigint"), F.col("a") + F.col("n") + F.col("r")).alias("shown"))


@query(
    "lookup_chain",
    "SELECT o_orderkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def lookup_chain(spark, sf_dir):
    """Two look-ups after another, with a name for what is not found."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("o_orderkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


PAGE_PATH = "split(regexp_replace(url, '^[a-z]+://', ''), '/')"


@query(
    "longest_prefix",
    "WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS path FROM pages), n AS (SELECT DISTINCT path[1:k] AS path FROM p, (VALUES (1), (2)) v(k) WHERE len(path) >= k), x AS (SELECT page_id, n.path, row_number() OVER (PARTITION BY page_id ORDER BY len(n.path) DESC) AS r FROM p JOIN n ON p.path[1:len(n.path)] = n.path AND len(n.path) <= len(p.path)) SELECT page_id, array_to_string(path, '/') AS node FROM x WHERE r = 1",
)
def longest_prefix(spark, sf_dir):
    """Each page with the most specific node of a dictionary that begins its path."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(PAGE_PATH).alias("path"))
    node = F.explode(F.filter(F.array(F.slice("path", 1, 1), F.slice("path", 1, 2)), lambda x: F.size(x) > 0))
    nodes = p.select(node.alias("node")).distinct()
    return c.longest_prefix(p, F.col("path"), nodes, "node", "page_id").select("page_id", F.array_join("node", "/").alias("node"))


@query(
    "prefix_roots",
    "WITH p AS (SELECT DISTINCT path FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS path FROM pages UNION ALL SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1:2] FROM pages)) SELECT array_to_string(path, '/') AS root FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE len(q.path) < len(p.path) AND p.path[1:len(q.path)] = q.path)",
)
def prefix_roots(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(PAGE_PATH).alias("path"))
    both = p.select("path").union(p.select(F.slice("path", 1, 2)))
    return c.roots(both, "path").select(F.array_join("path", "/").alias("root"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("no_reply", f"{W}, a AS (SELECT source, count(*) AS n FROM log WHERE program = 'view' GROUP BY 1 HAVING count(*) >= 3) SELECT source, n, (SELECT count(*) > 0 FROM log WHERE program = 'purchase') AS any_reply FROM a WHERE NOT EXISTS (SELECT 1 FROM log b WHERE b.source = a.source AND b.program = 'purchase' AND b.severity = 4 AND b.k > 90)")
def no_reply(spark, sf_dir):
    rows = log(spark, sf_dir)
    asked = rows.where("program = 'view'").groupBy("source").agg(F.count("*").alias("n")).where("n >= 3")
    replies = rows.where("program = 'purchase' and severity = 4 and k > 90")
    any_reply = rows.agg((F.count_if(F.col("program") == "purchase") > 0).alias("any_reply"))
    return asked.join(replies, "source", "left_anti").crossJoin(F.broadcast(any_reply))


@query("trace_exclusion", "WITH t AS (SELECT l_partkey, l_orderkey % 10 AS probe FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2) SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.l_partkey = a.l_partkey AND t.probe = a.l_orderkey % 10)")
def trace_exclusion(spark, sf_dir):
    """Lines whose probe was not answered by several."""
    rows = table(spark, sf_dir, "lineitem").withColumn("probe", F.col("l_orderkey") % 10)
    traces = rows.groupBy("l_partkey", "probe").agg(F.countDistinct("l_suppkey").alias("n")).where("n >= 2")
    return rows.join(traces, ["l_partkey", "probe"], "left_anti").select("l_orderkey", "l_linenumber")


@query("name_by_address", f"{W}, n AS (SELECT address, count(DISTINCT host) AS hosts, first(host ORDER BY c DESC, host) AS host FROM (SELECT address, host, count(*) AS c FROM log GROUP BY 1, 2) GROUP BY 1) SELECT id, CASE WHEN hosts = 1 THEN n.host ELSE log.address END AS device FROM log JOIN n ON log.address = n.address")
def name_by_address(spark, sf_dir):
    rows = log(spark, sf_dir)
    counted = rows.groupBy("address", "host").agg(F.count("*").alias("c"))
    names = counted.groupBy("address").agg(F.count("*").alias("hosts"), F.min_by("host", F.struct(-F.col("c"), F.col("host"))).alias("name"))
    return rows.join(names, "address").select("id", F.when(F.col("hosts") == 1, F.col("name")).otherwise(F.col("address")).alias("device"))


@query("last_identity", f"{W} SELECT source, coalesce(last(address ORDER BY t, id) FILTER (program = 'signup'), last(address ORDER BY t, id) FILTER (program = 'view')) AS address FROM log GROUP BY 1")
def last_identity(spark, sf_dir):
    order = F.struct("t", "id")
    of = lambda kind: F.max_by("address", F.when(F.col("program") == kind, order))
    return log(spark, sf_dir).groupBy("source").agg(F.coalesce(of("signup"), of("view")).alias("address"))


@query("set_difference", f"{W}, a AS (SELECT port, list_sort(list(DISTINCT source) FILTER (severity <= 4)) AS bad, list(DISTINCT source) FILTER (program = 'signup') AS fresh FROM log GROUP BY 1) SELECT port, list_filter(bad, lambda x: NOT list_contains(fresh, x)) AS others FROM a")
def set_difference(spark, sf_dir):
    """Per port the sources with problems that never signed up: distinct pairs and an anti-join, so that no task holds a port's sources but for the answer."""
    rows = log(spark, sf_dir)
    fresh = rows.where("program = 'signup'").select("port", "source").distinct()
    others = rows.where("severity <= 4").select("port", "source").distinct().join(fresh, ["port", "source"], "left_anti")
    return rows.select("port").distinct().join(others.groupBy("port").agg(F.array_sort(F.collect_list("source")).alias("others")), "port", "left").select("port", F.coalesce("others", F.array().cast("array<bigint>")).alias("others"))


@query("late_orders", "SELECT o_orderkey, count(*) AS lines, max(date_diff('day', o_orderdate, l_shipdate))::BIGINT AS slowest FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY 1")
def late_orders(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    late = j.where(micros(F.col("l_shipdate")) > micros(F.col("o_orderdate")) + 60 * DAY)
    return late.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.max(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))).cast("bigint").alias("slowest"))
