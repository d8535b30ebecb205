"""Hellos and requests cut over segments that come out of order and twice, put together again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packets as k
from ..operators import flows, payloads
from ..sources.views import LOG_SQL, log
from .registry import query


def _sized(width: int, body):
    return F.get(F.transform(F.array(body), lambda b: F.concat(k.hex_of(F.shiftright(F.length(b), 1), width), b)), F.lit(0))


def client_hello(name, newest):
    """A TLS hello with a server name, and with supported versions where newest, as text in hex."""
    host = F.hex(name.cast("binary"))
    named = F.concat(F.lit("0000"), _sized(2, _sized(2, F.concat(F.lit("00"), _sized(2, host)))))
    versions = F.when(newest, F.lit("002b0005040304" + "0303")).otherwise(F.lit(""))
    padding = F.lit("0015" + "0020" + "00" * 32)
    body = F.concat(F.lit("0303" + "ab" * 32 + "20" + "cd" * 32 + "0004" + "13011302" + "0100"), _sized(2, F.concat(padding, versions, named)))
    return F.concat(F.lit("160301"), _sized(2, F.concat(F.lit("01"), _sized(3, body))))


def frames(spark, sf_dir):
    """(id, part, t, data): a conversation for each event: a SYN, then a hello or a request in three pieces, in one of six orders, the second one twice."""
    e = log(spark, sf_dir).select("id", "t", "source", "host", "k")
    name = F.concat("host", F.lit("."), F.col("k").cast("string"), F.lit(".example"))
    request = F.concat(F.lit("GET /item/"), F.col("id").cast("string"), F.lit(" HTTP/1.1\r\nAccept: */*\r\nHost: "), name, F.lit("\r\nX: y\r\n\r\n"))
    whole = F.when(F.col("id") % 2 == 0, client_hello(name, F.col("id") % 4 == 0)).otherwise(F.hex(request.cast("binary")))
    e = e.withColumn("whole", F.unhex(whole)).withColumn("one", (F.col("k") % 20 + 3).cast("int")).withColumn("two", (F.col("k") % 20 + 30).cast("int"))
    piece = lambda a, b: F.struct(a.alias("at"), b.alias("size"))
    pieces = F.array(piece(F.lit(0), F.col("one")), piece(F.col("one"), F.col("two") - F.col("one")), piece(F.col("two"), F.octet_length("whole") - F.col("two")))
    orders = F.array(*(F.array(*map(F.lit, o)) for o in ((1, 2, 3, 2), (1, 3, 2, 2), (2, 1, 3, 2), (2, 3, 1, 2), (3, 1, 2, 2), (3, 2, 1, 2))))
    order = F.concat(F.array(F.lit(0)), F.element_at(orders, (F.col("id") % 6 + 1).cast("int")))
    sent = e.withColumn("pieces", pieces).select("*", F.posexplode(order).alias("part", "which")).withColumn("piece", F.when(F.col("which") > 0, F.element_at("pieces", F.greatest("which", F.lit(1)))))
    payload = F.coalesce(F.expr("substring(whole, piece.at + 1, piece.size)"), F.lit("").cast("binary"))
    base = F.lit((1 << 32) - 20) + F.col("id") % 10  # numbers wrap within the hello
    seq = (base + F.when(F.col("which") == 0, 0).otherwise(F.col("piece.at") + 1)) % (1 << 32)
    server = F.when(F.col("id") % 2 == 0, 443).otherwise(F.lit(8080))
    data = k.tcp_frame(F.lit(167772160) + F.col("source"), F.lit(2886729728) + F.floor(F.col("id") / 50_000), F.lit(10_000) + F.col("id") % 50_000, server, seq, F.lit(0), F.when(F.col("which") == 0, 2).otherwise(16), payload)
    return sent.select((F.col("id") * 8 + F.col("part")).alias("id"), (F.col("t") + F.col("part") * 1000).alias("t"), data.alias("data"))


def conversations(spark, sf_dir):
    d = k.decoded(frames(spark, sf_dir).withColumn("frame", F.col("data"))).where("proto = 6")
    return flows.segments(d.withColumn("payload", F.expr("substring(frame, cast(payload_at as int) + 1, cast(payload_length as int))")).drop("frame"))


NAME_SQL = f"""{LOG_SQL}, n AS (SELECT id, host || '.' || k || '.example' AS name FROM log)"""


@query(
    "tcp_names",
    f"WITH {NAME_SQL} SELECT (10000 + id % 50000)::BIGINT AS port, CASE WHEN id % 2 = 0 THEN name END AS sni, CASE WHEN id % 4 = 0 THEN 'TLS 1.3' WHEN id % 2 = 0 THEN 'TLS 1.2' END AS tls_version, CASE WHEN id % 2 = 1 THEN 'GET' END AS method, CASE WHEN id % 2 = 1 THEN '/item/' || id END AS path, CASE WHEN id % 2 = 1 THEN name END AS http_host FROM n",
)
def tcp_names(spark, sf_dir):
    """The server name of each hello and the host of each request."""
    n = payloads.names(conversations(spark, sf_dir))
    return n.select(F.greatest("a.port", "b.port").alias("port"), "sni", "tls_version", "method", "path", "http_host")


@query(
    "tcp_applications",
    f"WITH {NAME_SQL} SELECT CASE WHEN id % 2 = 0 THEN name ELSE 'http' END AS application, count(*) AS conversations FROM n GROUP BY 1",
)
def tcp_applications(spark, sf_dir):
    """Conversations by application: a hello's name before the protocol before the port."""
    n = payloads.names(conversations(spark, sf_dir))
    app = payloads.application(F.least("a.port", "b.port"), F.col("sni"), F.col("tls_version"), F.col("method").isNotNull())
    return n.groupBy(app.alias("application")).agg(F.count("*").alias("conversations"))
