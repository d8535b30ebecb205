"""Lines and frames made from the tables, parsed back; the SQL goes to the values that they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packets as k
from ..functions import syslog as s
from ..sources.views import LOG_SQL, log, table
from .registry import query

W = f"WITH {LOG_SQL}"


@query("priority_decode", f"{W} SELECT id, facility * 8 + severity AS priority, facility, severity FROM log")
def priority_decode(spark, sf_dir):
    pri = s.priority(F.col("raw"))
    return log(spark, sf_dir).select("id", pri.alias("priority"), s.facility(pri).alias("facility"), s.severity(pri).alias("severity"))


@query("iso_header", f"{W} SELECT id, t // 1000000 * 1000000 AS device_t, host, program, pid, 'k=' || k || ' srcip=' || address || ' user=u' || source AS message FROM log")
def iso_header(spark, sf_dir):
    g = lambda i: s.group(F.col("raw"), s.ISO_LINE, i)
    return log(spark, sf_dir).select("id", s.iso_micros(g(2)).alias("device_t"), g(3).alias("host"), g(4).alias("program"), g(5).alias("pid"), g(6).alias("message"))


@query("rfc3164_header", f"{W} SELECT id, t // 1000000 * 1000000 AS device_t, host, program, pid FROM log")
def rfc3164_header(spark, sf_dir):
    line = F.concat(F.lit("<13>"), F.date_format("received", "MMM d HH:mm:ss"), F.lit(" "), "host", F.lit(" "), "program", F.when(F.col("pid").isNull(), "").otherwise(F.concat(F.lit("["), "pid", F.lit("]"))), F.lit(": x"))
    rows = log(spark, sf_dir).withColumn("line", line)
    g = lambda i: s.group(F.col("line"), s.RFC3164, i)
    return rows.select("id", s.rfc3164_micros(g(2), g(3), g(4), F.col("received")).alias("device_t"), g(5).alias("host"), g(6).alias("program"), g(7).alias("pid"))


@query(
    "rfc5424_header",
    f"{W} SELECT id, host, program, pid, 'M' || k AS msgid, 'u' || source AS user_field, 'a\"b]' || k AS odd, 2 AS fields, 'rest ' || id AS message FROM log",
)
def rfc5424_header(spark, sf_dir):
    data = F.concat(F.lit('[ex@1 user="u'), F.col("source").cast("string"), F.lit('"][x odd="a\\"b\\]'), F.col("k").cast("string"), F.lit('"]'))
    line = F.concat(F.lit("<165>1 2024-01-01T00:00:00.000Z "), "host", F.lit(" "), "program", F.lit(" "), F.coalesce("pid", F.lit("-")), F.lit(" M"), F.col("k").cast("string"), F.lit(" "), data, F.lit(" rest "), F.col("id").cast("string"))
    rows = log(spark, sf_dir).withColumn("line", line)
    g = lambda i: s.group(F.col("line"), s.RFC5424, i)
    rows = rows.select("id", g(3).alias("host"), g(4).alias("program"), g(5).alias("pid"), g(6).alias("msgid"), g(7).alias("rest")).withColumn("fields", s.structured_data(F.col("rest")))
    return rows.select("id", "host", "program", "pid", "msgid", s.value_of(F.col("fields"), "sd.ex@1.user").alias("user_field"), s.value_of(F.col("fields"), "sd.x.odd").alias("odd"), F.size("fields").alias("fields"), s.without_structured_data(F.col("rest")).alias("message"))


@query("key_value_fields", f"{W} SELECT id, k::VARCHAR AS k, address AS srcip, 'u' || source AS user_field, 3 AS n FROM log")
def key_value_fields(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("f", s.key_values(F.col("message")))
    return rows.select("id", *(s.value_of(F.col("f"), n).alias(a) for n, a in (("k", "k"), ("SRCIP", "srcip"), ("user", "user_field"))), F.size("f").alias("n"))


def _vendor_lines(spark, sf_dir):
    n, host, k_ = F.col("id").cast("string"), F.col("host"), F.col("k").cast("string")
    lines = [
        F.concat(F.lit("Event|"), n, F.lit("|LOG_WARN|lldpd|1|neighbour of "), host, F.lit("|left")),
        F.concat(F.lit("1,2024/01/01,0011,SYSTEM,vpn,x,y,z,"), F.concat(F.lit('"ev,'), k_, F.lit('"')), F.lit(",a,b,c,d,high")),
        F.concat(F.lit('logid="'), n, F.lit('" type="traffic" devname="'), host, F.lit('" level="notice"')),
        F.concat(F.lit("%%01IFNET/4/LINK_STATE(l)["), n, F.lit("]:Interface "), host, F.lit(" has gone")),
        F.concat(F.lit("00"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" ports: port "), k_, F.lit(" is off-line")),
        F.concat(F.lit("product=VPN;action=drop;rule="), k_, F.lit(";")),
        F.lit("nothing special"),
    ]
    return log(spark, sf_dir).withColumn("line", F.element_at(F.array(*lines), (F.col("id") % 7 + 1).cast("int")))


@query("vendor_detect", "SELECT event_id AS id, ['aos-cx', 'pan-os', 'fortios', 'vrp', 'aos-s', 'check-point', 'generic'][event_id % 7 + 1] AS vendor FROM events")
def vendor_detect(spark, sf_dir):
    return _vendor_lines(spark, sf_dir).select("id", s.vendor(F.col("line")).alias("vendor"))


@query(
    "vendor_fields",
    f"""{W} SELECT id, CASE id % 7 WHEN 0 THEN 'lldpd' WHEN 1 THEN 'ev,' || k WHEN 2 THEN host WHEN 3 THEN 'LINK_STATE' END AS what, CASE id % 7 WHEN 0 THEN 'neighbour of ' || host || '|left' WHEN 1 THEN 'high' WHEN 2 THEN 'notice' WHEN 3 THEN 'Interface ' || host || ' has gone' END AS detail FROM log""",
)
def vendor_fields(spark, sf_dir):
    rows = _vendor_lines(spark, sf_dir).withColumn("vendor", s.vendor(F.col("line")))
    line = F.col("line")
    cx, vrp, kv, pan = s.aos_cx(line), s.vrp(line), s.key_values(line), s.pan_os(line)
    is_ = lambda v: F.col("vendor") == v
    what = F.when(is_("aos-cx"), cx["module"]).when(is_("pan-os"), s.value_of(pan, "eventid")).when(is_("fortios"), s.value_of(kv, "devname")).when(is_("vrp"), vrp["mnemonic"])
    detail = F.when(is_("aos-cx"), cx["text"]).when(is_("pan-os"), s.value_of(pan, "severity")).when(is_("fortios"), s.value_of(kv, "level")).when(is_("vrp"), vrp["text"])
    return rows.select("id", what.alias("what"), detail.alias("detail"))


@query("epoch_by_digits", f"{W} SELECT id, CASE id % 4 WHEN 0 THEN t // 1000000 * 1000000 WHEN 1 THEN t // 1000 * 1000 ELSE t END AS device_t FROM log")
def epoch_by_digits(spark, sf_dir):
    t = F.col("t")
    text = F.element_at(F.array(F.expr("t div 1000000").cast("string"), F.expr("t div 1000").cast("string"), t.cast("string"), F.concat(t.cast("string"), F.lit("789"))), (F.col("id") % 4 + 1).cast("int"))
    return log(spark, sf_dir).select("id", s.epoch_micros(text).alias("device_t"))


@query("stream_frames", f"{W} SELECT id, 3 AS frames, '<1>' || host AS first, '<2>' || program AS second, '<3>' || id AS third FROM log")
def stream_frames(spark, sf_dir):
    """An octet-counted message, a line, another counted one, and the beginning of a fourth."""
    one, two, three = F.concat(F.lit("<1>"), "host"), F.concat(F.lit("<2>"), "program"), F.concat(F.lit("<3>"), F.col("id").cast("string"))
    counted = lambda m: F.concat(F.length(m).cast("string"), F.lit(" "), m)
    rows = log(spark, sf_dir).select("id", s.frames(F.concat(counted(one), two, F.lit("\r\n"), counted(three), F.lit("12 <4>"))).alias("f"))
    return rows.select("id", F.size("f").alias("frames"), *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))))


@query("page_titles", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")).alias("title"))


# ---- frames -----------------------------------------------------------------------------------------------------

#: A packet for each event: a client (by user) and a server (by k) talk; the event's type is the segment's kind.
PACKET_SQL = """pkt AS (SELECT event_id AS id, epoch_us(ts) AS t, 167772160 + user_id AS client, 2886729728 + k % 8 AS server, (49152 + user_id % 1000) AS cport, [443, 80, 22][k % 3 + 1] AS sport_,
  event_type = 'signup' OR event_type = 'error' AS back, CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 18 WHEN 'view' THEN 16 WHEN 'purchase' THEN 24 ELSE 20 END AS flags, CASE WHEN event_type = 'purchase' THEN length(event_id::VARCHAR) ELSE 0 END AS payload, event_id * 977 % 4294967296 AS seq
  FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INT AS k FROM events))"""


def frames(spark, sf_dir):
    """(id, t, data): TCP segments as Ethernet frames."""
    e = log(spark, sf_dir)
    flags = F.when(F.col("program") == "click", 2).when(F.col("program") == "signup", 18).when(F.col("program") == "view", 16).when(F.col("program") == "purchase", 24).otherwise(20)
    back = F.col("program").isin("signup", "error")
    client, server = F.lit(167772160) + F.col("source"), F.lit(2886729728) + F.col("k") % 8
    cport = F.lit(49152) + F.col("source") % 1000
    sport = F.element_at(F.array(F.lit(443), F.lit(80), F.lit(22)), F.col("k") % 3 + 1).cast("bigint")
    way = lambda a, b: F.when(back, b).otherwise(a)
    payload = F.when(F.col("program") == "purchase", F.col("id").cast("string")).otherwise("").cast("binary")
    vlan = F.when(F.col("id") % 3 == 0, F.col("id") % 4000 + 1)
    return e.select("id", "t", k.tcp_frame(way(client, server), way(server, client), way(cport, sport), way(sport, cport), F.col("id") * 977 % (1 << 32), F.lit(0), flags, payload, vlan).alias("data"))


@query(
    "packet_decode",
    f"WITH {PACKET_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN id % 4000 + 1 END AS vlan, 6::BIGINT AS proto, CASE WHEN back THEN sport_ ELSE cport END::BIGINT AS sport, CASE WHEN back THEN cport ELSE sport_ END::BIGINT AS dport, seq, flags::BIGINT AS flags, payload::BIGINT AS payload_length, CASE WHEN back THEN server ELSE client END AS source_number FROM pkt",
)
def packet_decode(spark, sf_dir):
    from ..functions.addresses import ipv4_number

    d = k.decoded(frames(spark, sf_dir))
    return d.select("id", "vlan", "proto", "sport", "dport", "seq", "flags", "payload_length", ipv4_number("source").alias("source_number"))


@query("packet_flags", f"WITH {PACKET_SQL} SELECT flags::BIGINT AS flags, CASE flags WHEN 2 THEN 'SYN' WHEN 18 THEN 'SYN,ACK' WHEN 16 THEN 'ACK' WHEN 24 THEN 'PSH,ACK' ELSE 'RST,ACK' END AS label, count(*) AS packets FROM pkt GROUP BY 1, 2")
def packet_flags(spark, sf_dir):
    return k.decoded(frames(spark, sf_dir)).groupBy("flags").agg(F.count("*").alias("packets")).select("flags", k.flag_label(F.col("flags")).alias("label"), "packets")


@query("packet_port_filter", f"WITH {PACKET_SQL} SELECT id FROM pkt WHERE sport_ = 443 AND flags = 2")
def packet_port_filter(spark, sf_dir):
    https = k.SERVICES["https"]
    return k.decoded(frames(spark, sf_dir)).where(((F.col("sport") == https) | (F.col("dport") == https)) & k.has(F.col("flags"), "SYN") & ~k.has(F.col("flags"), "ACK")).select("id")


# ---- messages in frames -----------------------------------------------------------------------------------------


@query(
    "dns_decode",
    f"WITH {LOG_SQL} SELECT id, id % 65536 AS dns_id, id % 2 = 1 AS dns_response, CASE WHEN id % 2 = 1 THEN k % 4 ELSE 0 END::BIGINT AS dns_rcode, host || '.example' AS dns_name, CASE WHEN id % 2 = 1 THEN 53 ELSE 40000 + source % 1000 END AS sport FROM log",
)
def dns_decode(spark, sf_dir):
    """Queries and answers in UDP frames."""
    return k.decoded(dns_frames(spark, sf_dir)).select("id", "dns_id", "dns_response", "dns_rcode", "dns_name", "sport")


@query(
    "dns_answers",
    f"WITH {LOG_SQL} SELECT id, host || '.site.example' AS dns_name, 1::BIGINT AS dns_type, 'web' || k || '.example, 10.9.' || (k % 7) || '.' || (k % 250) AS answers FROM log",
)
def dns_answers(spark, sf_dir):
    """Answers with an alias and its address, names given by pointers; one in three to a multicast port."""
    e = log(spark, sf_dir)
    address = F.lit(10 << 24) + F.lit(9 << 16) + (F.col("k") % 7) * 256 + F.col("k") % 250
    payload = k.dns_answer_payload(F.col("id") % 65536, [F.col("host"), F.lit("site"), F.lit("example")], F.concat(F.lit("web"), F.col("k").cast("string")), address)
    port = F.when(F.col("id") % 3 == 0, 5353).otherwise(53)
    d = k.decoded(e.select("id", k.udp_frame(F.lit(2886729728), F.lit(167772160) + F.col("source"), port, F.lit(40000), payload).alias("data")))
    return d.select("id", "dns_name", "dns_type", F.array_join("dns_answers", ", ").alias("answers"))


def dns_frames(spark, sf_dir):
    e = log(spark, sf_dir)
    answer = F.col("id") % 2 == 1
    client, server = F.lit(167772160) + F.col("source"), F.lit(2886729728) + F.col("source") % 3
    port = F.lit(40000) + F.col("source") % 1000
    way = lambda a, b: F.when(answer, b).otherwise(a)
    payload = k.dns_payload(F.col("id") % 65536, answer, F.when(answer, F.col("k") % 4).otherwise(0), F.col("host"), F.lit("example"))
    return e.select("id", "t", k.udp_frame(way(client, server), way(server, client), way(port, F.lit(53)), way(F.lit(53), port), payload).alias("data"))


@query(
    "dns_failure_share",
    f"WITH {LOG_SQL} SELECT (2886729728 + source % 3)::BIGINT AS server, count(*) AS answers, count(*) FILTER (k % 4 <> 0) AS failed, count(*) >= 10 AND count(*) FILTER (k % 4 <> 0) >= 0.3 * count(*) AS reported FROM log WHERE id % 2 = 1 GROUP BY 1",
)
def dns_failure_share(spark, sf_dir):
    """Servers with three in ten answers failed, of ten at least, from decoded frames."""
    from ..functions.addresses import ipv4_number

    answers = k.decoded(dns_frames(spark, sf_dir)).where("dns_response")
    s_ = answers.groupBy("source").agg(F.count("*").alias("answers"), F.count_if(F.col("dns_rcode") != 0).alias("failed"))
    return s_.select(ipv4_number("source").alias("server"), "answers", "failed", ((F.col("answers") >= 10) & (F.col("failed") >= 0.3 * F.col("answers"))).alias("reported"))


@query(
    "dhcp_decode",
    f"WITH {LOG_SQL} SELECT id, id % 6 + 1 AS dhcp_type, (id * 77) % 4294967296 AS dhcp_xid, lower('02:00:' || lpad(to_hex(source // 16777216 % 256), 2, '0') || ':' || lpad(to_hex(source // 65536 % 256), 2, '0') || ':' || lpad(to_hex(source // 256 % 256), 2, '0') || ':' || lpad(to_hex(source % 256), 2, '0')) AS dhcp_client, CASE WHEN id % 2 = 1 THEN '10.0.0.' || k % 3 END AS dhcp_server, CASE WHEN id % 2 = 1 THEN 60 * (k % 10) END::BIGINT AS dhcp_lease FROM log",
)
def dhcp_decode(spark, sf_dir):
    """Messages of clients and servers, the latter with server and lease."""
    return k.decoded(dhcp_frames(spark, sf_dir)).select("id", "dhcp_type", "dhcp_xid", F.lower("dhcp_client").alias("dhcp_client"), "dhcp_server", "dhcp_lease")


def dhcp_frames(spark, sf_dir):
    e = log(spark, sf_dir)
    served = F.col("id") % 2 == 1
    payload = k.dhcp_payload(F.col("id") % 6 + 1, F.col("id") * 77 % (1 << 32), F.lit(0x020000000000) + F.col("source"), F.when(served, F.lit(167772160) + F.col("k") % 3), F.when(served, 60 * (F.col("k") % 10)))
    return e.select("id", "t", k.udp_frame(F.lit(0), F.lit((1 << 32) - 1), F.when(served, 67).otherwise(68), F.when(served, 68).otherwise(67), payload).alias("data"))


@query(
    "dhcp_short_lease",
    f"WITH {LOG_SQL} SELECT '10.0.0.' || k % 3 AS dhcp_server, min(60 * (k % 10))::BIGINT AS shortest, count(*) AS leases FROM log WHERE id % 2 = 1 AND id % 6 + 1 = 2 AND 60 * (k % 10) < 300 GROUP BY 1",
)
def dhcp_short_lease(spark, sf_dir):
    """Servers that offer less than five minutes."""
    offers = k.decoded(dhcp_frames(spark, sf_dir)).where("dhcp_type = 2 and dhcp_lease < 300")
    return offers.groupBy("dhcp_server").agg(F.min("dhcp_lease").alias("shortest"), F.count("*").alias("leases"))


@query(
    "ipv6_decode",
    f"WITH {LOG_SQL} SELECT id, lower('fd00::' || CASE WHEN source % 65536 > 0 THEN to_hex(source % 65536) ELSE '' END) AS source, 'fd00::1:0' AS destination, 10::BIGINT AS vlan, 2::BIGINT AS tags, 6::BIGINT AS proto, 64::BIGINT AS ttl, (1000 + id % 400)::BIGINT AS mss, 7::BIGINT AS window_scale, 0::BIGINT AS payload_length, 443::BIGINT AS dport FROM log",
)
def ipv6_decode(spark, sf_dir):
    """Segments in IPv6 behind two tags and a header between, with options."""
    e = log(spark, sf_dir)
    text = F.concat(F.lit("fd00" + "0" * 20), k.hex_of(F.col("source") % 65536, 4))
    frames_ = e.select("id", k.ipv6_frame(text, F.lit("fd00" + "0" * 20 + "00010000"), F.lit(50000), F.lit(443), F.lit(2), F.lit(1000) + F.col("id") % 400).alias("data"))
    d = k.decoded(frames_)
    return d.select("id", F.lower("source").alias("source"), "destination", "vlan", "tags", "proto", "ttl", "mss", "window_scale", "payload_length", "dport")
