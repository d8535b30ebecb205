"""Rules of DNS, DHCP, ARP, ICMP and SNMP over facts taken from the log view, walks over order lines, and point look-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import addresses as a
from ..functions import predicates as p
from ..operators import correlate as c
from ..operators import sequences as s
from ..operators import walks
from ..sources.views import LOG_SQL, log, table
from .registry import query

DAY, HOUR = 86_400_000_000, 3_600_000_000
W = f"WITH {LOG_SQL}"


@query(
    "dns_transactions",
    f"""{W}, x AS (SELECT source, t, id, program, CASE WHEN program = 'view' THEN id END AS q FROM log WHERE program IN ('view', 'click')),
y AS (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY source ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS open FROM x),
r AS (SELECT open, min((t, id)) AS first FROM y WHERE program = 'click' AND open IS NOT NULL GROUP BY 1)
SELECT x.id, first[2] AS answer, first[1] - x.t AS took FROM x LEFT JOIN r ON r.open = x.id WHERE x.program = 'view'""",
)
def dns_transactions(spark, sf_dir):
    """Queries and answers of one key: an answer goes to the latest open query, and a query's first answer counts."""
    rows = log(spark, sf_dir).where("program in ('view', 'click')").select("source", "t", "id", "program")
    w = Window.partitionBy("source").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("open", F.last(F.when(F.col("program") == "view", F.col("id")), ignorenulls=True).over(w))
    first = seen.where("program = 'click' and open is not null").groupBy(F.col("open").alias("id")).agg(F.min(F.struct("t", "id")).alias("m"))
    asked = rows.where("program = 'view'").select("id", "t")
    return asked.join(first, "id", "left").select("id", F.col("m.id").alias("answer"), (F.col("m.t") - F.col("t")).alias("took"))


@query(
    "dns_failures",
    f"""{W}, m AS (SELECT port, t // {DAY} AS day, count(*) AS n, count(*) FILTER (program = 'error') AS hard, count(*) FILTER (severity <= 4) AS bad FROM log GROUP BY 1, 2),
o AS (SELECT port, sum(n) AS n, sum(hard) AS hard, sum(bad) AS bad, max(CASE WHEN n >= 10 THEN bad / n ELSE 0 END) AS worst FROM m GROUP BY 1)
SELECT port, n::BIGINT AS queries, bad::BIGINT AS failed, CASE WHEN hard / n >= 0.3 THEN 3 ELSE 2 END AS severity FROM o WHERE n >= 10 AND (bad / n >= 0.3 OR worst >= 0.3)""",
)
def dns_failures(spark, sf_dir):
    m = log(spark, sf_dir).groupBy("port", F.expr(f"t div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("program") == "error").alias("hard"), F.count_if(F.col("severity") <= 4).alias("bad"))
    worst = F.max(F.when(F.col("n") >= 10, F.col("bad") / F.col("n")).otherwise(0.0)).alias("worst")
    o = m.groupBy("port").agg(F.sum("n").alias("queries"), F.sum("hard").alias("hard"), F.sum("bad").alias("failed"), worst)
    o = o.where((F.col("queries") >= 10) & ((F.col("failed") / F.col("queries") >= 0.3) | (F.col("worst") >= 0.3)))
    return o.select("port", "queries", "failed", F.when(F.col("hard") / F.col("queries") >= 0.3, 3).otherwise(2).alias("severity"))


@query(
    "dhcp_no_answer",
    f"""{W}, e AS (SELECT max(t) AS stop FROM log), d AS (SELECT port, source, id FROM log x, e WHERE program = 'view' AND t <= stop - {12 * HOUR} AND NOT EXISTS (SELECT 1 FROM log y WHERE y.program = 'click' AND y.source = x.source AND y.t BETWEEN x.t AND x.t + {12 * HOUR}))
SELECT port AS vlan, count(*) AS clients, sum(n)::BIGINT AS discovers FROM (SELECT port, source, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1""",
)
def dhcp_no_answer(spark, sf_dir):
    """Clients with three requests that nothing answered in time, by VLAN; requests at the log's end are not settled."""
    rows = log(spark, sf_dir).select("port", "source", "t", "id", "program")
    end = rows.agg(F.max("t").alias("stop"))
    asked = rows.where("program = 'view'").crossJoin(F.broadcast(end)).where(F.col("t") <= F.col("stop") - 12 * HOUR)
    offers = rows.where("program = 'click'").select("source", F.col("t").alias("other_t"))
    open_ = c.within(asked, offers, ["source"], 0, 12 * HOUR, "left_anti")
    clients = open_.groupBy("port", "source").agg(F.count("*").alias("n")).where("n >= 3")
    return clients.groupBy(F.col("port").alias("vlan")).agg(F.count("*").alias("clients"), F.sum("n").alias("discovers"))


@query("dhcp_two_servers", f"{W} SELECT facility AS vlan, count(DISTINCT address) AS servers, min(k) AS shortest_lease FROM log WHERE program = 'signup' GROUP BY 1 HAVING count(DISTINCT address) >= 2")
def dhcp_two_servers(spark, sf_dir):
    g = log(spark, sf_dir).where("program = 'signup'").groupBy(F.col("facility").alias("vlan")).agg(F.countDistinct("address").alias("servers"), F.min("k").alias("shortest_lease"))
    return g.where("servers >= 2")


@query(
    "arp_unanswered",
    f"{W}, r AS (SELECT address, count(*) AS requests FROM log WHERE program = 'view' GROUP BY 1 HAVING count(*) >= 3) SELECT address, requests, CASE WHEN (SELECT count(*) FROM log WHERE program = 'purchase') > 0 THEN 3 ELSE 2 END AS severity FROM r WHERE NOT EXISTS (SELECT 1 FROM log x WHERE x.address = r.address AND x.program = 'purchase' AND x.k < 20)",
)
def arp_unanswered(spark, sf_dir):
    rows = log(spark, sf_dir)
    asked = rows.where("program = 'view'").groupBy("address").agg(F.count("*").alias("requests")).where("requests >= 3")
    replies = rows.where("program = 'purchase' and k < 20").select("address")
    any_ = rows.agg(F.when(F.count_if(F.col("program") == "purchase") > 0, 3).otherwise(2).alias("severity"))
    return asked.join(replies, "address", "left_anti").crossJoin(F.broadcast(any_))


@query(
    "icmp_burst",
    f"""{W}, e AS (SELECT * FROM log WHERE program = 'error'), tr AS (SELECT k, facility FROM e GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2),
b AS (SELECT port, count(*) OVER (PARTITION BY port ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.k = e.k AND tr.facility = e.facility))
SELECT port, max(n) AS most FROM b GROUP BY 1 HAVING max(n) >= 3""",
)
def icmp_burst(spark, sf_dir):
    """Bursts of errors per router, without those that look like a trace (several routers answer one probe)."""
    e = log(spark, sf_dir).where("program = 'error'")
    traces = e.groupBy("k", "facility").agg(F.countDistinct("source").alias("n")).where("n >= 2")
    return s.burst(e.join(traces, ["k", "facility"], "left_anti"), "port", 6 * HOUR).where("most >= 3").select("port", "most")


# ---- walks ------------------------------------------------------------------------------------------------------


@query("walk_subtree", "SELECT l_orderkey AS id, l_linenumber AS line, [1, 3, 6, l_suppkey % 5, l_partkey % 7, l_linenumber] AS oid FROM lineitem WHERE l_suppkey % 5 = 2 AND l_partkey % 7 = 3")
def walk_subtree(spark, sf_dir):
    """The variables under one root."""
    return walks.under(walks.variables(table(spark, sf_dir, "lineitem")), "1.3.6.2.3").select("id", "line", "oid")


@query("walk_columns", "SELECT l_suppkey AS host, l_partkey % 7 AS if_index, max(CASE WHEN l_linenumber = 1 THEN l_quantity::BIGINT END) AS in_octets, max(CASE WHEN l_linenumber = 2 THEN l_quantity::BIGINT END) AS out_octets, max(CASE WHEN l_linenumber = 3 THEN l_quantity::BIGINT END) AS in_errors FROM lineitem GROUP BY 1, 2")
def walk_columns(spark, sf_dir):
    """Rows of an interface table from its variables: a row for each index, a column for each object."""
    return walks.interfaces(walks.variables(table(spark, sf_dir, "lineitem")))


@query(
    "walk_names",
    "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_suppkey % 5 = 2 AND l_partkey % 7 = 3 THEN 'ifTable' WHEN l_suppkey % 5 = 2 THEN 'interfaces' ELSE 'internet' END AS name, CASE WHEN l_suppkey % 5 = 2 AND l_partkey % 7 = 3 THEN [l_linenumber] WHEN l_suppkey % 5 = 2 THEN [l_partkey % 7, l_linenumber] ELSE [l_suppkey % 5, l_partkey % 7, l_linenumber] END AS instance FROM lineitem",
)
def walk_names(spark, sf_dir):
    """Each variable with the most specific name of a dictionary, and what of its id is the instance."""
    names = [("1.3.6", "internet"), ("1.3.6.2", "interfaces"), ("1.3.6.2.3", "ifTable")]
    return walks.named(walks.variables(table(spark, sf_dir, "lineitem")), names).select("id", "line", "name", "instance")


@query(
    "walk_discards",
    "WITH g AS (SELECT l_suppkey AS port, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS discards, sum(l_quantity)::BIGINT AS packets FROM lineitem GROUP BY 1) SELECT port, discards, packets FROM g WHERE discards * 10000 >= 95 * packets",
)
def walk_discards(spark, sf_dir):
    """Ports with many discards for their packets."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("port")).agg(F.count_if(F.col("l_returnflag") == "R").alias("discards"), F.sum("l_quantity").cast("bigint").alias("packets"))
    return g.where(F.col("discards") * 10000 >= 95 * F.col("packets"))


# ---- look-ups ---------------------------------------------------------------------------------------------------


@query("row_by_id", "SELECT event_id, user_id, event_type FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)")
def row_by_id(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    wanted = e.agg(F.expr("max(event_id) div 2").alias("event_id"))
    return e.join(F.broadcast(wanted), "event_id", "left_semi").select("event_id", "user_id", "event_type")


@query("lower_bound", "SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id >= user_id * 50 GROUP BY 1")
def lower_bound(spark, sf_dir):
    """Of each user, the first event at or after a place."""
    return table(spark, sf_dir, "events").where("event_id >= user_id * 50").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("presence_count", "SELECT o_orderstatus, count(*) AS held FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def presence_count(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(held, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("held"))


@query(
    "flow_of_frame",
    f"""{W}, g AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT source, t, id, CASE WHEN t - lag(t) OVER (PARTITION BY source ORDER BY t, id) > {DAY} THEN 1 ELSE 0 END AS new FROM log)),
f AS (SELECT source, n, min(t) AS first, max(t) AS last FROM g GROUP BY 1, 2)
SELECT log.id, f.n::BIGINT AS session FROM log JOIN f ON log.source = f.source AND log.t BETWEEN f.first AND f.last WHERE log.program = 'error'""",
)
def flow_of_frame(spark, sf_dir):
    """The session whose first and last event stand around each error."""
    rows = log(spark, sf_dir)
    f = s.sessions(rows.select("source", "t", "id"), "source", DAY)
    errors = rows.where("program = 'error'").select("source", "t", "id")
    started = f.select("source", F.col("first").alias("t"), F.struct("session", "last").alias("found_session"))
    at = c.last_before(errors, started, ["source"], "found_session")
    return at.where(F.col("t") <= F.col("found.last")).select("id", F.col("found.session").alias("session"))


@query("client_lines", f"{W} SELECT id, host, program FROM log WHERE address = '10.1.5.5' OR source = 21")
def client_lines(spark, sf_dir):
    """All lines about one client, by address or by name."""
    return log(spark, sf_dir).where(p.whole_address("raw", "10.1.5.5") | p.whole_word("raw", "u21")).select("id", "host", "program")


@query("document_addresses", r"SELECT doc_id, regexp_extract(text, '(^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))($|[^0-9.])', 2) AS found FROM documents WHERE regexp_matches(text, '(^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))($|[^0-9.])')")
def document_addresses(spark, sf_dir):
    """The first address in each text that has one with neither digit nor full stop beside it."""
    edge = r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?=$|[^0-9.])"
    found = F.filter(F.regexp_extract_all("text", F.lit(edge), F.lit(1)), lambda x: x.rlike(a.IPV4))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(found, F.lit(0)).alias("found")).where("found is not null")
