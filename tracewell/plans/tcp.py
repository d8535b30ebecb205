"""Conversations with loss, duplicate acknowledgements, probes and waits: frames made of events, judged segment by segment, and SQL that judges the same segments by windows of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import packets as k
from ..operators import flows, tcp
from ..sources.views import log
from .registry import query

# ---- frames -----------------------------------------------------------------------------------------------------

#: Sequence numbers begin near the end of their range for clients, so that they wrap.
CLIENT_BASE, SERVER_BASE = 4_294_967_000, 1000


def frames(spark, sf_dir):
    """(id, t, data): one conversation for each user: a handshake, then data, acknowledgements, resent data, probes and resets, by k."""
    w = Window.partitionBy("source").orderBy("t", "id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = log(spark, sf_dir).select("id", "t", "source", "k").withColumn("rn", F.row_number().over(w)).withColumn("place", F.col("k") % 10)
    later, place, kk = F.col("rn") > 3, F.col("place"), F.col("k")
    reset = later & (kk == 98)
    d = d.withColumn("back", (F.col("rn") == 2) | (later & place.isin(4, 5, 7)) | reset)
    back = F.col("back")
    d = d.withColumn("fresh", F.when(later & (place <= 3), 100 + kk).when(later & place.isin(4, 5), 200 + kk).otherwise(0).cast("long"))
    off = lambda side: F.coalesce(F.sum(F.when(back == F.lit(side), F.col("fresh"))).over(past), F.lit(0)) + 1
    d = d.withColumn("off_c", off(False)).withColumn("off_s", off(True)).withColumn("was", F.coalesce(F.last(F.when(~back & (F.col("fresh") > 0), F.col("fresh")), ignorenulls=True).over(past), F.lit(0)))
    known = lambda side, other: F.last(F.when((back == F.lit(side)) & (kk % 4 != 3), F.col(other)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("known", F.coalesce(F.when(back, known(True, "off_c")).otherwise(known(False, "off_s")), F.lit(1)))
    again, keep, probe = later & (place == 8) & ~reset, later & (place == 9) & (kk % 20 == 19), later & (place == 9) & (kk % 20 == 9)
    size = F.when(again, F.col("was")).when(probe, 1).otherwise(F.col("fresh"))
    at = F.when(F.col("rn") <= 2, 0).otherwise(F.when(back, F.col("off_s")).otherwise(F.col("off_c")) - F.when(again, F.col("was")).when(keep, 1).otherwise(0))
    seq = (F.when(back, F.lit(SERVER_BASE)).otherwise(F.lit(CLIENT_BASE)) + F.col("source") + at) % (1 << 32)
    ack = F.when(F.col("rn") == 1, 0).otherwise((F.when(back, F.lit(CLIENT_BASE)).otherwise(F.lit(SERVER_BASE)) + F.col("source") + F.col("known")) % (1 << 32))
    flags = F.when(F.col("rn") == 1, 2).when(F.col("rn") == 2, 18).when(reset, 20).when(size > 0, 24).otherwise(16)
    window = F.when(later & (kk % 20 == 7), 0).when(kk % 30 == 26, 8292).otherwise(8192)
    client, server = F.lit(167772160) + F.col("source"), F.lit(2886729728) + F.col("source") % 8
    way = lambda x, y: F.when(back, y).otherwise(x)
    port = F.lit(50000) + F.col("source") % 1000
    payload = F.expr("repeat('x', cast(_size as int))").cast("binary")
    d = d.withColumn("_size", size)
    return d.select("id", "t", k.tcp_frame(way(client, server), way(server, client), way(port, F.lit(443)), way(F.lit(443), port), seq, ack, flags, payload, None, window).alias("data"))


def judged(spark, sf_dir):
    return tcp.with_client(tcp.verdicts(flows.segments(k.decoded(frames(spark, sf_dir)).where("proto = 6"))))


def facts(spark, sf_dir):
    seen = judged(spark, sf_dir)
    return tcp.conversation_facts(seen, tcp.waits(seen))


# ---- the same by SQL --------------------------------------------------------------------------------------------

PAST = "(PARTITION BY source ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = "(PARTITION BY source ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def sides(name: str, kind: str, value: str) -> str:
    """own_<name> and peer_<name>: the last, greatest, first or summed value of each side's rows before."""
    call = {"last": "last_value({} IGNORE NULLS)", "first": "first_value({} IGNORE NULLS)", "max": "max({})", "sum": "sum({})"}[kind]
    of = lambda side: f"{call.format(f'CASE WHEN {side} THEN {value} END')} OVER {PAST}"
    return f"CASE WHEN back THEN {of('back')} ELSE {of('NOT back')} END AS own_{name}, CASE WHEN back THEN {of('NOT back')} ELSE {of('back')} END AS peer_{name}"


SEGMENT_SQL = f"""e AS (SELECT event_id AS id, epoch_us(ts) AS t, user_id AS source, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e1 AS (SELECT *, rn > 3 AS later, rn > 3 AND k = 98 AS reset, rn = 2 OR (rn > 3 AND k % 10 IN (4, 5, 7)) OR (rn > 3 AND k = 98) AS back,
  CASE WHEN rn > 3 AND k % 10 <= 3 THEN 100 + k WHEN rn > 3 AND k % 10 IN (4, 5) THEN 200 + k ELSE 0 END::BIGINT AS fresh FROM e),
e2 AS (SELECT *, coalesce(sum(CASE WHEN NOT back THEN fresh END) OVER {PAST}, 0)::BIGINT + 1 AS off_c, coalesce(sum(CASE WHEN back THEN fresh END) OVER {PAST}, 0)::BIGINT + 1 AS off_s,
  coalesce(last_value(CASE WHEN NOT back AND fresh > 0 THEN fresh END IGNORE NULLS) OVER {PAST}, 0) AS was FROM e1),
e3 AS (SELECT *, coalesce(CASE WHEN back THEN last_value(CASE WHEN back AND k % 4 <> 3 THEN off_c END IGNORE NULLS) OVER {UPTO} ELSE last_value(CASE WHEN NOT back AND k % 4 <> 3 THEN off_s END IGNORE NULLS) OVER {UPTO} END, 1) AS known,
  later AND k % 10 = 8 AND NOT reset AS resend, later AND k % 20 = 19 AS keep, later AND k % 20 = 9 AS one FROM e2),
seg AS (SELECT id, t, source, back, CASE WHEN resend THEN was WHEN one THEN 1 ELSE fresh END AS n,
  CASE WHEN rn <= 2 THEN 0 ELSE CASE WHEN back THEN off_s ELSE off_c END - CASE WHEN resend THEN was WHEN keep THEN 1 ELSE 0 END END AS u,
  CASE WHEN rn > 1 THEN known END AS acked, rn = 1 AS is_syn, rn = 2 AS is_reply, reset,
  CASE WHEN later AND k % 20 = 7 THEN 0 WHEN k % 30 = 26 THEN 8292 ELSE 8192 END AS win FROM e3),
j0 AS (SELECT *, u + n + CASE WHEN is_syn OR is_reply THEN 1 ELSE 0 END AS ends, is_syn OR is_reply AS numbered, is_syn OR is_reply OR reset AS special FROM seg),
j1 AS (SELECT *, {sides("win", "last", "win")}, {sides("t", "last", "t")}, {sides("acked", "last", "acked")}, {sides("most", "max", "acked")}, {sides("syn", "last", "CASE WHEN is_syn THEN t END")} FROM j0),
j2 AS (SELECT *, {sides("sent", "max", "CASE WHEN NOT (n = 1 AND coalesce(peer_win, 1) = 0 AND NOT numbered) THEN ends END")}, {sides("all", "max", "ends")} FROM j1),
j3 AS (SELECT *, CASE WHEN own_all IS NULL THEN own_sent ELSE greatest(own_sent, CASE WHEN peer_most IS NULL THEN own_all ELSE least(own_all, peer_most) END) END AS nxt FROM j2),
j4 AS (SELECT *, coalesce(n = 1 AND u = nxt AND peer_win = 0, false) AS probe FROM j3),
j5 AS (SELECT *, coalesce(NOT probe AND NOT special AND n <= 1 AND u = nxt - 1, false) AS alive, CASE WHEN NOT is_syn AND NOT is_reply AND acked IS NOT NULL AND t > greatest(own_syn, peer_syn) THEN t - greatest(own_syn, peer_syn) END AS trip,
  nxt IS NULL OR ends > nxt + numbered::INT AS further FROM j4),
j6 AS (SELECT *, {sides("alive", "last", "alive")}, {sides("probe", "last", "probe")}, {sides("grew", "last", "CASE WHEN further THEN n END")}, first_value(trip IGNORE NULLS) OVER {PAST} AS first_trip FROM j5),
j7 AS (SELECT *, NOT special AND NOT probe AND n = 0 AND coalesce(u = nxt, false) AS quiet, acked IS NOT DISTINCT FROM own_acked AS same FROM j6),
j8 AS (SELECT *, coalesce(quiet AND win = own_win AND win <> 0 AND same AND peer_alive, false) AS alive_ack, coalesce(quiet AND win = own_win AND win = 0 AND (same OR acked = own_acked + 1) AND peer_probe, false) AS probe_ack,
  coalesce(quiet AND win <> own_win AND win <> 0 AND same, false) AS upd, coalesce(quiet AND win = own_win AND win <> 0 AND same, false) AND NOT coalesce(quiet AND win = own_win AND win <> 0 AND same AND peer_alive, false) AS twice FROM j7),
j9 AS (SELECT *, {sides("twice", "sum", "twice::INT")} FROM j8),
j10 AS (SELECT *, {sides("since", "last", "CASE WHEN NOT same THEN coalesce(own_twice, 0) END")} FROM j9),
j11 AS (SELECT *, coalesce(peer_twice, 0) - coalesce(peer_since, 0) AS in_row, n > 0 OR numbered AS carries, coalesce(n > 0 AND u + n <= peer_acked, false) AS spurious, coalesce(u < nxt AND NOT (n > 1 AND u = nxt - 1), false) AS late, t - peer_t AS soon FROM j10),
j12 AS (SELECT *, CASE WHEN NOT carries OR alive OR probe THEN NULL WHEN spurious THEN 'spurious retransmission' WHEN late AND coalesce(soon < 20000 AND in_row >= 2 AND peer_acked = u, false) THEN 'fast retransmission' WHEN late THEN 'late' END AS sort,
  coalesce(soon < coalesce(first_trip, 3000), false) AND (coalesce(nxt <> ends, false) OR coalesce(own_grew = 0, false)) AS reordered FROM j11),
known_late AS (SELECT DISTINCT l.id FROM j12 l JOIN j0 s ON s.source = l.source AND s.back = l.back AND (s.t < l.t OR (s.t = l.t AND s.id < l.id)) AND s.ends > s.u AND greatest(s.u, coalesce(l.peer_most, s.u)) <= l.u AND s.ends >= l.ends AND s.ends > coalesce(l.peer_most, s.u)
  WHERE l.sort = 'late' AND l.reordered),
judged AS (SELECT *, CASE WHEN probe THEN 'zero-window probe' WHEN alive THEN 'keep-alive' WHEN alive_ack THEN 'keep-alive ACK' WHEN probe_ack THEN 'probe ACK'
  WHEN sort = 'late' THEN CASE WHEN reordered AND id NOT IN (SELECT id FROM known_late) THEN 'out of order' ELSE 'retransmission' END WHEN sort IS NOT NULL THEN sort
  WHEN twice THEN 'duplicate ACK' WHEN upd THEN 'window update' WHEN coalesce(acked > greatest(peer_all, own_most), false) THEN 'unseen segment acknowledged' WHEN coalesce(u > nxt, false) AND NOT reset THEN 'segment before not captured' END AS verdict,
  win = 0 AND NOT special AND NOT probe AS zero_window FROM j12)"""

WAIT_SQL = f"""{SEGMENT_SQL},
data AS (SELECT source, t, id, NOT back AS asks FROM judged WHERE n > 0 AND coalesce(verdict NOT IN ('retransmission', 'fast retransmission', 'spurious retransmission', 'out of order', 'keep-alive', 'zero-window probe'), true)),
begun AS (SELECT *, asks AND NOT coalesce(lag(asks) OVER (PARTITION BY source ORDER BY t, id), false) AS begins FROM data),
turned AS (SELECT *, sum(begins::INT) OVER (PARTITION BY source ORDER BY t, id)::BIGINT AS turn FROM begun),
waits AS (SELECT source, turn, max(t) FILTER (asks) AS asked, min(t) FILTER (NOT asks) AS answered, min(t) FILTER (NOT asks) - max(t) FILTER (asks) AS wait FROM turned WHERE turn > 0 GROUP BY 1, 2)"""

FACT_SQL = f"""{WAIT_SQL},
g AS (SELECT source, count(*) AS packets, count(*) FILTER (n > 0) AS data_segments, count(*) FILTER (verdict IN ('retransmission', 'fast retransmission', 'spurious retransmission')) AS resent,
  count(*) FILTER (verdict = 'spurious retransmission') AS spurious, count(*) FILTER (zero_window) AS zeros, min(t) FILTER (is_reply) AS reply, max(t) FILTER (is_syn) AS syn,
  min((t, id)) FILTER (reset) AS rst, min((t, id)) FILTER (n > 0 AND back) AS served, min((t, id)) FILTER (is_reply) AS replied FROM judged GROUP BY 1),
facts AS (SELECT g.*, 2886729728 + source % 8 AS server, CASE WHEN reply > syn THEN reply - syn END AS handshake, rst IS NOT NULL AND (served IS NULL OR served > rst) AND replied IS NOT NULL AND replied < rst AS early_reset, longest
  FROM g LEFT JOIN (SELECT source, max(wait) AS longest FROM waits GROUP BY 1) USING (source)),
ends AS (SELECT server, count(*) FILTER (early_reset) AS resets, sum(resent - spurious) FILTER (data_segments >= 20) AS lost, sum(packets) FILTER (data_segments >= 20) AS packets, count(handshake) AS shakes, count(*) FILTER (handshake > 300000) AS slow_shakes,
  count(*) FILTER (zeros > 0) AS closed, count(*) FILTER (longest > 3000000) AS slow, max(longest) AS wait FROM facts GROUP BY 1)"""


@query("tcp_verdicts", f"WITH {SEGMENT_SQL} SELECT id, verdict, zero_window FROM judged")
def tcp_verdicts(spark, sf_dir):
    """Each segment's verdict: loss, duplicates, probes, order."""
    return judged(spark, sf_dir).select("id", "verdict", "zero_window")


@query("tcp_waits", f"WITH {WAIT_SQL} SELECT (167772160 + source)::BIGINT AS client, turn, asked, answered, wait FROM waits")
def tcp_waits(spark, sf_dir):
    """How long each turn of a conversation waited for its first answer."""
    from ..functions.addresses import ipv4_number

    seen = judged(spark, sf_dir)
    clients = seen.select("a", "b", "conversation", F.when(F.col("client_forward"), F.col("a.ip")).otherwise(F.col("b.ip")).alias("client")).distinct()
    return tcp.waits(seen).join(clients, ["a", "b", "conversation"]).select(ipv4_number("client").alias("client"), "turn", "asked", "answered", "wait")


def _rule(name: str, when: str, severity: str, count: str, value: str) -> tuple[str, str]:
    return name, f"WITH {FACT_SQL} SELECT server::BIGINT AS server, {severity}::INTEGER AS severity, {count}::BIGINT AS \"count\", {value}::DOUBLE AS value FROM ends WHERE {when}"


RULES = {
    "tcp.serverReset": _rule("tcp_server_reset", "resets > 0", "CASE WHEN resets >= 3 THEN 3 ELSE 2 END", "resets", "resets"),
    "tcp.retransmissions": _rule("tcp_retransmissions", "lost >= 3 AND lost / packets >= 0.02", "CASE WHEN lost / packets >= 0.05 THEN 3 ELSE 2 END", "lost", "lost / packets"),
    "tcp.slowHandshake": _rule("tcp_slow_handshake", "shakes > 0 AND slow_shakes >= shakes - shakes // 2", "2", "slow_shakes", "shakes"),
    "tcp.zeroWindow": _rule("tcp_zero_window", "closed > 0", "2", "closed", "closed"),
    "tcp.slowResponse": _rule("tcp_slow_response", "slow > 0", "2", "slow", "wait"),
}


def _register(rule: str, name: str, sql: str) -> None:
    def run(spark, sf_dir):
        from ..functions.addresses import ipv4_number

        return tcp.endpoint_findings(facts(spark, sf_dir)).where(F.col("rule") == rule).select(ipv4_number("server").alias("server"), "severity", "count", "value")

    query(name, sql)(run)


for _name, (_query, _sql) in RULES.items():
    _register(_name, _query, _sql)
