"""Findings over the log view, conversations over frames, and what a report says of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packets as k
from ..operators import findings as f
from ..operators import flows as fl
from ..sources.stored import stored
from ..sources.views import LOG_SQL, log
from .parsers import PACKET_SQL, frames
from .registry import query

DAY, HOUR = 86_400_000_000, 3_600_000_000
NOW = 1706745600000000
SHOWN = ("rule", "severity", "category", "device", "title", "first", "last", "count", "evidence")

ABOUT = "min(t) AS first, max(t) AS last, count(*) AS count, list_sort(list(id))[1:50] AS evidence"
FINDINGS_SQL = f"""
downs AS (SELECT * FROM log WHERE program = 'error'),
flap AS (SELECT host, max(n) AS most FROM (SELECT host, count(*) OVER (PARTITION BY host ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS n FROM downs) GROUP BY 1),
addr AS (SELECT address, max(n) AS most, count(*) AS events FROM (SELECT address, count(*) OVER (PARTITION BY address ORDER BY t RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS n FROM downs) GROUP BY 1),
stuck AS (SELECT host FROM log GROUP BY 1 HAVING last(program ORDER BY t, id) = 'error' AND {NOW} - max(t) > {HOUR}),
ud AS (SELECT host, t, id, program = 'purchase' AS up, lag(program = 'purchase') OVER (PARTITION BY host ORDER BY t, id) AS before FROM log WHERE program IN ('error', 'purchase')),
ustate AS (SELECT host, NOT last(up ORDER BY t, id) AS still FROM ud GROUP BY 1),
outages AS (SELECT host, {ABOUT} FROM ud WHERE NOT up AND coalesce(before, true) GROUP BY 1),
conf AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY host ORDER BY t, id) <= {HOUR} THEN 0 ELSE 1 END AS new FROM log WHERE program = 'signup'),
prob AS (SELECT *, t // {DAY} AS day FROM log WHERE severity <= 4),
pd AS (SELECT host, day, count(*) AS n FROM prob GROUP BY 1, 2),
spike AS (SELECT host, max(n) AS peak, first(day ORDER BY n DESC, day) AS day, sum(n) AS total, max(day) - min(day) + 1 AS span FROM pd GROUP BY 1),
hp AS (SELECT *, 'port ' || port AS part, t // {HOUR} AS hour FROM log),
busy AS (SELECT part, hour FROM hp GROUP BY 1, 2 HAVING count(*) >= 4),
many AS (SELECT part, count(*) AS hours FROM busy GROUP BY 1 HAVING count(*) >= 2),
findings AS (
SELECT 'link.flap' AS rule, 3 AS severity, 'link' AS category, host AS device, 'down ' || max(most) || ' times in a window' AS title, {ABOUT} FROM downs JOIN flap USING (host) WHERE most >= 3 GROUP BY host
UNION ALL SELECT 'link.down', 2, 'link', host, 'down since its last line', {ABOUT} FROM downs JOIN stuck USING (host) GROUP BY host
UNION ALL SELECT 'login.failures', CASE WHEN max(most) >= 4 THEN 3 ELSE 1 END, 'login', address, count(*) || ' failures', {ABOUT} FROM downs JOIN addr USING (address) WHERE events >= 2 GROUP BY address
UNION ALL SELECT 'routing.neighbor', CASE WHEN still THEN 3 ELSE 2 END, 'routing', host, count || ' outages', first, last, count, evidence FROM outages JOIN ustate USING (host) WHERE still OR count >= 2
UNION ALL SELECT 'config.change', 1, 'config', host, sum(new)::BIGINT || ' changes', {ABOUT} FROM conf GROUP BY host
UNION ALL SELECT 'syslog.errorSpike', 2, 'syslog', host, max(peak) || ' problems in a day', {ABOUT} FROM prob JOIN spike USING (host, day) WHERE span >= 10 AND peak >= 3 * greatest((total - peak) / greatest(span - 1, 1), 0.5) GROUP BY host
UNION ALL SELECT 'capacity.logRate', 2, 'capacity', part, max(hours) || ' busy hours', {ABOUT} FROM hp JOIN busy USING (part, hour) JOIN many USING (part) GROUP BY part)"""
W = f"WITH {LOG_SQL}, {FINDINGS_SQL}"


def found(spark, sf_dir):
    """The findings of all rules over a log that is read once: what the rules need of it is stored."""
    rows = log(spark, sf_dir).select("id", "t", "host", "address", "program", "severity", "port")
    return f.analyse(stored(rows), NOW)


for _name in f.RULES:

    def _one(spark, sf_dir, name=_name):
        return f.analyse(log(spark, sf_dir), NOW, [name])

    query("rule_" + _name.replace(".", "_"), f"{W} SELECT * FROM findings WHERE rule = '{_name}'")(_one)


@query("findings_ordered", f"{W} SELECT * FROM findings")
def findings_ordered(spark, sf_dir):
    return f.ordered(found(spark, sf_dir))


@query("findings_chips", f"{W}, c AS (SELECT * FROM (VALUES ('link', 0), ('login', 1), ('routing', 2), ('config', 3), ('syslog', 4), ('capacity', 5), ('tcp', 6)) v(category, place)) SELECT category, place, count(rule) AS n, count(*) FILTER (severity >= 2) AS problems FROM c LEFT JOIN findings USING (category) GROUP BY 1, 2")
def findings_chips(spark, sf_dir):
    return f.chips(found(spark, sf_dir))


@query("findings_heading", f"{W} SELECT count(*) FILTER (severity = 3) AS bad, count(*) FILTER (severity = 2) AS warn, count(DISTINCT device) FILTER (severity >= 2) AS devices FROM findings WHERE last >= 1704412800000000 AND first <= 1705276800000000")
def findings_heading(spark, sf_dir):
    from ..functions.predicates import overlaps

    rows = found(spark, sf_dir).where(overlaps("first", "last", 1704412800000000, 1705276800000000))
    return rows.agg(F.count_if(F.col("severity") == 3).alias("bad"), F.count_if(F.col("severity") == 2).alias("warn"), F.countDistinct(F.when(F.col("severity") >= 2, F.col("device"))).alias("devices"))


@query("findings_filter", f"{W} SELECT rule, device, title FROM findings WHERE severity >= 2 AND category = 'link' AND (contains(lower(title), 'down') OR contains(lower(device), 'sw1'))")
def findings_filter(spark, sf_dir):
    from ..functions import predicates as p

    return found(spark, sf_dir).where(p.compare("severity", ">=", 2) & p.compare("category", "=", "link") & (p.word("title", "down") | p.word("device", "sw1"))).select("rule", "device", "title")


@query("findings_causes", f"{W}, c AS (SELECT rule, device, first, (SELECT last(l.id ORDER BY l.t, l.id) FROM log l WHERE l.host = findings.device AND l.program = 'signup' AND l.t BETWEEN findings.first - {2 * DAY} AND findings.first) AS cause FROM findings) SELECT rule, device, first, cause::BIGINT AS cause FROM c")
def findings_causes(spark, sf_dir):
    rows = log(spark, sf_dir)
    return f.with_causes(found(spark, sf_dir), rows.where("program = 'signup'"), 2 * DAY).select("rule", "device", "first", "cause")


@query("findings_liveness", f"{W}, e AS (SELECT rule, device, first, unnest(evidence) AS id FROM findings) SELECT rule, device, first, count(*) FILTER (id >= 5000) AS present, count(*) AS total FROM e GROUP BY 1, 2, 3")
def findings_liveness(spark, sf_dir):
    return f.liveness(found(spark, sf_dir), log(spark, sf_dir).where("id >= 5000").select("id"))


@query(
    "findings_report",
    f"{W}, g AS (SELECT severity, category, count(*) AS n, list_sort(list(DISTINCT device)) AS d FROM findings GROUP BY 1, 2) SELECT severity, category, '- **' || ['info', 'warn', 'bad'][severity] || '** ' || category || ': ' || n || ' on ' || CASE WHEN len(d) = 1 THEN d[1] WHEN len(d) = 2 THEN d[1] || ' and ' || d[2] WHEN len(d) = 3 THEN d[1] || ', ' || d[2] || ' and ' || d[3] ELSE d[1] || ', ' || d[2] || ', ' || d[3] || ' and ' || (len(d) - 3) || ' more' END AS line FROM g",
)
def findings_report(spark, sf_dir):
    return f.report_lines(found(spark, sf_dir))


# ---- conversations ----------------------------------------------------------------------------------------------


ADDRESS = "({0} // 16777216) || '.' || ({0} // 65536 % 256) || '.' || ({0} // 256 % 256) || '.' || ({0} % 256)"
PAIR = "PARTITION BY client, cport, server, sport_ ORDER BY t, id"
PAST = f"({PAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: The conversations of pkt, by windows of its own: SYN is 2, SYN and ACK 18, RST and ACK 20.
FLOW_SQL = f"""{PACKET_SQL},
s1 AS (SELECT *, t - lag(t) OVER ({PAIR}) AS gap, max(CASE WHEN flags = 20 THEN t END) OVER {PAST} AS ended,
  last_value(CASE WHEN flags = 2 THEN seq END IGNORE NULLS) OVER {PAST} AS syn_seq, last_value(CASE WHEN flags = 2 THEN t END IGNORE NULLS) OVER {PAST} AS syn_t FROM pkt),
s2 AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND flags = 2 AND (syn_seq IS NULL OR syn_seq <> seq) AND (gap > 60000000 OR ended >= coalesce(syn_t, 0)) THEN 1 ELSE 0 END) OVER ({PAIR} ROWS UNBOUNDED PRECEDING)::BIGINT AS conversation,
  payload + CASE WHEN flags IN (2, 18) THEN 1 ELSE 0 END AS size FROM s1),
s3 AS (SELECT *, size > 0 AND coalesce(seq + size <= max(seq + size) OVER (PARTITION BY client, cport, server, sport_, conversation, back ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM s2),
g AS (SELECT client AS c, cport::BIGINT AS client_port, server AS s, sport_::BIGINT AS server_port, conversation, count(*) AS packets, count(*) FILTER (again) AS lost, count(*) FILTER (flags = 2) AS syns, min(t) FILTER (flags = 18) AS synack,
  max(t) FILTER (flags = 2) AS syn, min(t) FILTER (flags = 20) AS rst, count(*) FILTER (flags NOT IN (2, 20)) AS more, min(t) AS first, max(t) AS last FROM s3 GROUP BY 1, 2, 3, 4, 5),
h AS (SELECT *, syns > 0 AND synack IS NULL AND rst IS NULL AND more = 0 AS never_answered, syns > 0 AND synack IS NULL AND rst IS NOT NULL AND more = 0 AS refused, lost >= 3 AND lost / packets >= 0.02 AS resent FROM g),
flow AS (SELECT *, {ADDRESS.format("c")} AS client, {ADDRESS.format("s")} AS server, list_filter([CASE WHEN never_answered THEN 'never answered' END, CASE WHEN refused THEN 'refused' END, CASE WHEN rst IS NOT NULL AND NOT refused THEN 'reset' END, CASE WHEN resent THEN 'retransmissions' END], lambda x: x IS NOT NULL) AS why FROM h)"""


def conversations(spark, sf_dir):
    return fl.flows(k.decoded(frames(spark, sf_dir)).where("proto = 6"))


@query(
    "flow_counters",
    f"WITH {PACKET_SQL} SELECT client, cport::BIGINT AS client_port, server, sport_::BIGINT AS server_port, count(*) AS packets, sum(payload)::BIGINT AS bytes, count(*) FILTER (payload > 0) AS data_segments, count(*) FILTER (flags = 2) AS syns, min(t) AS first, max(t) AS last FROM pkt GROUP BY 1, 2, 3, 4",
)
def flow_counters(spark, sf_dir):
    """Bytes and segments of each pair of ends, over all its conversations."""
    from ..functions.addresses import ipv4_number

    c = conversations(spark, sf_dir)
    low = lambda x: F.when(F.col("client.port") >= 49152, F.col(f"client.{x}")).otherwise(F.col(f"server.{x}"))
    high = lambda x: F.when(F.col("client.port") >= 49152, F.col(f"server.{x}")).otherwise(F.col(f"client.{x}"))
    keyed = c.select(ipv4_number(low("ip")).alias("client"), low("port").alias("client_port"), ipv4_number(high("ip")).alias("server"), high("port").alias("server_port"), "packets", "bytes", "data_segments", "syns", "first", "last")
    return keyed.groupBy("client", "client_port", "server", "server_port").agg(*(F.sum(x).alias(x) for x in ("packets", "bytes", "data_segments", "syns")), F.min("first").alias("first"), F.max("last").alias("last"))


@query(
    "flow_health",
    f"WITH {FLOW_SQL} SELECT client, client_port, server, server_port, conversation, packets, lost, syns, CASE WHEN syn < synack THEN synack - syn END AS handshake_us, never_answered, refused, rst IS NOT NULL AS reset, CASE WHEN never_answered OR resent THEN 'bad' WHEN len(why) > 0 THEN 'warn' ELSE 'ok' END AS health, array_to_string(why, ', ') AS reasons, first, last FROM flow",
)
def flow_health(spark, sf_dir):
    """Conversations with their outcome; the tests hold it against a step-by-step replay as well."""
    c = conversations(spark, sf_dir)
    return c.select(F.col("client.ip").alias("client"), F.col("client.port").alias("client_port"), F.col("server.ip").alias("server"), F.col("server.port").alias("server_port"), "conversation", "packets", "lost", "syns", "handshake_us", "never_answered", "refused", "reset", "health", F.array_join("reasons", ", ").alias("reasons"), "first", "last")


@query("tcp_refused", f"WITH {FLOW_SQL} SELECT server, server_port AS port, count(DISTINCT client) AS clients, sum(syns)::BIGINT AS tries, CASE WHEN count(DISTINCT client) >= 3 THEN 3 WHEN sum(syns) >= 3 OR count(DISTINCT client) >= 2 THEN 2 ELSE 1 END AS severity FROM flow WHERE refused GROUP BY 1, 2")
def tcp_refused(spark, sf_dir):
    """Servers and ports that refuse: three clients are bad, three tries or two clients warn, else a note."""
    g = conversations(spark, sf_dir).where("refused").groupBy(F.col("server.ip").alias("server"), F.col("server.port").alias("port")).agg(F.countDistinct("client.ip").alias("clients"), F.sum("syns").alias("tries"))
    return g.withColumn("severity", F.when(F.col("clients") >= 3, 3).when((F.col("tries") >= 3) | (F.col("clients") >= 2), 2).otherwise(1))


@query("tcp_unanswered", f"WITH {FLOW_SQL} SELECT server, server_port AS port, count(DISTINCT client) AS clients, sum(syns)::BIGINT AS tries FROM flow WHERE never_answered GROUP BY 1, 2 HAVING sum(syns) >= 3 OR count(DISTINCT client) >= 3")
def tcp_unanswered(spark, sf_dir):
    """Servers and ports whose connection requests stay unanswered: three attempts or three clients."""
    g = conversations(spark, sf_dir).where("never_answered").groupBy(F.col("server.ip").alias("server"), F.col("server.port").alias("port")).agg(F.countDistinct("client.ip").alias("clients"), F.sum("syns").alias("tries"))
    return g.where("tries >= 3 or clients >= 3")
