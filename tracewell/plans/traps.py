"""Notifications in BER, built from events, decoded to var-binds, made log rows, and what those report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import snmp as s
from ..functions.facts import with_facts
from ..sources.views import LOG_SQL, log
from .registry import query

IF = (1, 3, 6, 1, 2, 1, 2, 2, 1)


def messages(spark, sf_dir):
    """(id, t, data): by id, a link going down or up (version 2), one of an enterprise's own, and generic and specific ones of version 1."""
    e = log(spark, sf_dir)
    n, uptime = F.col("id") % 400, F.col("id") % 100_000_000
    name = F.concat(F.lit("port "), n.cast("string"))
    text = lambda c: s.tlv(s.OCTETS, F.hex(c.cast("binary")))
    binds = [
        s.bind(s.oid_hex(*IF, 1, n), s.number_hex(s.INTEGER, n, 2)),
        s.bind(s.oid_hex(*IF, 2, n), text(name)),
        s.bind(s.oid_hex(1, 3, 6, 1, 2, 1, 31, 1, 1, 1, 6, n), s.number_hex(s.COUNTER64, F.col("id") * (1 << 33), 8)),
        s.bind(s.oid_hex(*IF, 6, n), text(F.unhex(F.lit("0205ff")))),
        s.bind(s.oid_hex(*IF, 8, n), s.number_hex(s.INTEGER, F.lit(0xFFFE), 2)),
        s.bind(s.oid_hex(1, 3, 6, 1, 4, 1, 9999, 1), F.lit("0500")),
    ]
    time = s.bind(s.oid_hex(1, 3, 6, 1, 2, 1, 1, 3, 0), s.number_hex(s.TICKS, uptime, 4))
    trap = lambda *oid: s.bind(s.oid_hex(1, 3, 6, 1, 6, 3, 1, 1, 4, 1, 0), s.oid_hex(*oid))
    data = (
        F.when(F.col("id") % 5 == 0, s.message_v2("public", [time, trap(1, 3, 6, 1, 6, 3, 1, 1, 5, 3), *binds]))
        .when(F.col("id") % 5 == 1, s.message_v2("public", [time, trap(1, 3, 6, 1, 6, 3, 1, 1, 5, 4), *binds[:2]], s.INFORM))
        .when(F.col("id") % 5 == 2, s.message_v2("c", [time, trap(1, 3, 6, 1, 4, 1, 9999, 0, n)]))
        .when(F.col("id") % 5 == 3, s.message_v1("public", s.oid_hex(1, 3, 6, 1, 4, 1, 9999), F.lit(167772160) + F.col("source"), F.lit(0), F.lit(0), uptime, binds[:1]))
        .otherwise(s.message_v1("public", s.oid_hex(1, 3, 6, 1, 4, 1, 9999), F.lit(0), F.lit(6), n, uptime, binds[1:2]))
    )
    return e.select("id", "t", data.alias("data"))


TRAP_SQL = f"""{LOG_SQL}, m AS (SELECT id, t, id % 5 AS kind, id % 400 AS n, id % 100000000 AS uptime, (167772160 + source)::BIGINT AS agent FROM log),
ag AS (SELECT *, (agent // 16777216) || '.' || (agent // 65536 % 256) || '.' || (agent // 256 % 256) || '.' || (agent % 256) AS address FROM m),
parts AS (SELECT *, CASE kind WHEN 0 THEN '1.3.6.1.6.3.1.1.5.3' WHEN 1 THEN '1.3.6.1.6.3.1.1.5.4' WHEN 2 THEN '1.3.6.1.4.1.9999.0.' || n WHEN 3 THEN '1.3.6.1.6.3.1.1.5.1' ELSE '1.3.6.1.4.1.9999.0.' || n END AS trap_oid,
  [{{'oid': '1.3.6.1.2.1.2.2.1.1.' || n, 'type': 'INTEGER', 'value': n::VARCHAR}}, {{'oid': '1.3.6.1.2.1.2.2.1.2.' || n, 'type': 'OCTET STRING', 'value': 'port ' || n}},
   {{'oid': '1.3.6.1.2.1.31.1.1.1.6.' || n, 'type': 'Counter64', 'value': (id::HUGEINT * 8589934592)::VARCHAR}}, {{'oid': '1.3.6.1.2.1.2.2.1.6.' || n, 'type': 'OCTET STRING', 'value': '02 05 ff'}},
   {{'oid': '1.3.6.1.2.1.2.2.1.8.' || n, 'type': 'INTEGER', 'value': '-2'}}, {{'oid': '1.3.6.1.4.1.9999.1', 'type': 'NULL', 'value': NULL}}] AS six,
  [{{'oid': '1.3.6.1.6.3.18.1.3.0', 'type': 'IpAddress', 'value': address}}] AS sent_by, [{{'oid': '1.3.6.1.6.3.1.1.4.3.0', 'type': 'OBJECT IDENTIFIER', 'value': '1.3.6.1.4.1.9999'}}] AS made_by FROM ag),
traps AS (SELECT *, CASE kind WHEN 0 THEN six WHEN 1 THEN six[1:2] WHEN 2 THEN six[1:0] WHEN 3 THEN six[1:1] || sent_by || made_by ELSE six[2:2] || made_by END AS binds FROM parts)"""
LINE_SQL = f"""{TRAP_SQL},
rows AS (SELECT id, CASE trap_oid WHEN '1.3.6.1.6.3.1.1.5.3' THEN 'linkDown' WHEN '1.3.6.1.6.3.1.1.5.4' THEN 'linkUp' WHEN '1.3.6.1.6.3.1.1.5.1' THEN 'coldStart' ELSE trap_oid END AS program, CASE WHEN kind IN (0, 3) THEN 4 ELSE 5 END AS severity,
  'SNMPv' || CASE WHEN kind > 2 THEN '1' ELSE '2c' END || CASE WHEN kind = 1 THEN ' inform ' ELSE ' trap ' END || trap_oid || coalesce(' ' || list_aggregate(list_transform(binds, lambda b: b.oid || '=' || coalesce(b.value, '')), 'string_agg', ' '), '') AS message,
  len(binds) + CASE WHEN kind > 2 THEN 5 ELSE 4 END AS n_fields, kind, n FROM traps)"""


@query("trap_binds", f"WITH {TRAP_SQL} SELECT id, trap_oid, uptime, pos::INTEGER AS pos, b.oid AS oid, b.type AS type, b.value AS value FROM (SELECT id, trap_oid, uptime, unnest(range(len(binds))) AS pos, unnest(binds) AS b FROM traps WHERE len(binds) > 0)")
def trap_binds(spark, sf_dir):
    """Each var-bind of each notification."""
    d = s.decoded(messages(spark, sf_dir))
    return d.select("id", "trap_oid", "uptime", F.posexplode("binds").alias("pos", "b")).select("id", "trap_oid", "uptime", "pos", "b.oid", "b.type", "b.value")


@query("trap_heads", f"WITH {TRAP_SQL} SELECT id, CASE WHEN kind > 2 THEN 1 ELSE 2 END::BIGINT AS version, CASE WHEN kind = 2 THEN 'c' ELSE 'public' END AS community, CASE WHEN kind = 1 THEN 'inform' ELSE 'trap' END AS kind, CASE kind WHEN 3 THEN address WHEN 4 THEN '0.0.0.0' END AS agent, len(binds)::INTEGER AS n_binds FROM traps")
def trap_heads(spark, sf_dir):
    """Version, community, kind and agent of each notification."""
    return s.decoded(messages(spark, sf_dir)).select("id", "version", "community", "kind", "agent", F.size("binds").alias("n_binds"))


@query("trap_lines", f"WITH {LINE_SQL} SELECT id, program, severity::INTEGER AS severity, message, n_fields::INTEGER AS n_fields FROM rows")
def trap_lines(spark, sf_dir):
    """Notifications as log rows."""
    return s.log_rows(s.decoded(messages(spark, sf_dir))).select("id", "program", "severity", "message", F.size("fields").alias("n_fields"))


@query("trap_facts", f"WITH {LINE_SQL} SELECT id, CASE WHEN kind < 2 THEN 'link' WHEN kind = 3 THEN 'restart' END AS fact, CASE WHEN kind < 2 THEN 'port ' || n WHEN kind = 3 THEN 'cold' END AS subject, CASE kind WHEN 0 THEN 'down' WHEN 1 THEN 'up' WHEN 3 THEN 'unplanned' END AS state FROM rows")
def trap_facts(spark, sf_dir):
    """What notifications report, by the classifiers of lines."""
    return with_facts(s.log_rows(s.decoded(messages(spark, sf_dir)))).select("id", "fact", "subject", "state")
