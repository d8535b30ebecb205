"""What TCP streams say first: bytes of segments put together by sequence number, and the names in a TLS hello or an HTTP request.

A direction's segments are put in order of their numbers; a running greatest end tells which bytes of each are new and where the first hole is. Bytes behind a hole are not looked at. Of segments
that overlap, the one that begins first in the stream gives the bytes, and of those that begin alike the one that was sent first. Only the first ``HEAD`` bytes of a direction are put together: a
hello, and a request's head, end before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.packets import SERVICES, Frames, has
from .tcp import KEYS, unwrapped

#: Bytes of a direction that are put together; the largest hello is a record of 16 KiB and its head.
HEAD = 1 << 16
#: The record and message of a hello, its extensions with names and versions, and names of versions.
HANDSHAKE, CLIENT_HELLO, SERVER_NAME, SUPPORTED = 22, 1, 0, 43
VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
METHODS = "GET|HEAD|POST|PUT|DELETE|OPTIONS|PATCH|CONNECT|TRACE"


def streams(segments: DataFrame, payload: str = "payload") -> DataFrame:
    """(a, b, conversation, forward, stream): the first bytes of each direction that has any. segments: conversations' segments with their payload."""
    d = unwrapped(segments)
    # A direction begins behind its SYN, or else with the lowest number seen.
    side = Window.partitionBy(*KEYS, "forward")
    base = F.coalesce(F.min(F.when(has(F.col("flags"), "SYN"), F.col("u") + 1)).over(side), F.min(F.when(F.col("payload_length") > 0, F.col("u"))).over(side))
    d = d.withColumn("_at", F.col("u") - base + F.when(has(F.col("flags"), "SYN"), 1).otherwise(0)).where(F.octet_length(payload) > 0).where((F.col("_at") < HEAD) & (F.col("_at") > -HEAD))
    order = side.orderBy("_at", "t", "id")
    past = F.greatest(F.coalesce(F.max(F.col("_at") + F.octet_length(payload)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    d = d.withColumn("_past", past).withColumn("_hole", F.max(F.col("_at") > F.col("_past")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = F.expr(f"substring(`{payload}`, cast(greatest(_past - _at, 0) as int) + 1)")
    parts = d.where("not _hole").select(*KEYS, "forward", "_at", "t", "id", F.hex(fresh).alias("_part")).where("_part <> ''")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "t", "id", "_part"))), lambda x: x["_part"])
    return parts.groupBy(*KEYS, "forward").agg(F.unhex(F.array_join(gathered, "")).alias("stream"))


def hello_fields(frames: Frames) -> tuple[np.ndarray, np.ndarray]:
    """The server name and the highest version that each stream's TLS hello offers, all streams at once, an extension at a time; null where there is none."""
    n = len(frames.start)
    number = frames.number
    record, ok = number(np.zeros(n, np.int64), 1)
    message, ok2 = number(5, 1)
    version, ok3 = number(9, 2)
    hello = ok & ok2 & ok3 & (record == HANDSHAKE) & (message == CLIENT_HELLO)
    at = np.full(n, 43)  # behind record, message, version and random bytes
    for width in (1, 2, 1):  # session, ciphers, compressions
        size, there = number(at, width)
        hello_so_far = hello & there
        at = np.where(hello_so_far, at + width + size, at)
        hello = hello_so_far
    size, there = number(at, 2)
    at, end = at + 2, at + 2 + size
    name, highest = np.full(n, None, object), np.where(hello, version, 0)
    open_ = hello & there
    while (open_ := open_ & (at + 4 <= end) & (at + 4 <= frames.size)).any():
        kind, _ = number(at, 2)
        size, _ = number(at + 2, 2)
        length, whole = number(at + 7, 2)
        named = open_ & (kind == SERVER_NAME) & whole & (at + 9 + length <= np.minimum(frames.size, at + 4 + size))
        for i in np.flatnonzero(named):  # a stream has one
            begin = frames.start[i] + at[i] + 9
            name[i] = frames.raw[begin : begin + length[i]].tobytes().decode("ascii", "replace")
        listed = open_ & (kind == SUPPORTED)
        if listed.any():
            count, _ = number(at + 4, 1)
            for k in range(0, 254, 2):
                more = listed & (k < count)
                if not more.any():
                    break
                value, there = number(at + 5 + k, 2)
                highest = np.where(more & there & np.isin(value, list(VERSIONS)), np.maximum(highest, value), highest)
        at = np.where(open_, at + 4 + size, at)
    return name, np.array([VERSIONS.get(int(v)) for v in highest], object)


def with_hello(df: DataFrame, stream: str = "stream") -> DataFrame:
    """df with sni and tls_version of the hello that its streams begin with."""

    def run(batches):
        for b in batches:
            name, version = hello_fields(Frames(b.column(b.schema.get_field_index(stream)).fill_null(b"")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name, pa.string()), pa.array(version, pa.string())], names=[*b.schema.names, "sni", "tls_version"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("sni", T.StringType()), T.StructField("tls_version", T.StringType())]))


def with_request(df: DataFrame, stream: str = "stream") -> DataFrame:
    """df with method, path, http_host and status of the HTTP message that its streams begin with."""
    text = F.decode(F.col(stream), "ISO-8859-1")
    one = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    request, answer = rf"^({METHODS}) (\S+) HTTP/1\.\d\r\n", r"^HTTP/1\.\d (\d{3})"
    host = F.when(one(request, 1).isNotNull(), one(r"(?i)^[^\r\n]*\r\n(?:[^\r\n]+\r\n)*?host: *([^\r\n]*?) *\r\n", 1))
    return df.withColumns({"method": one(request, 1), "path": one(request, 2), "http_host": host, "status": one(answer, 1).cast("int")})


def application(port: Column, sni: Column, tls_version: Column, http: Column) -> Column:
    """A conversation's application: the name in its hello, or TLS, or HTTP, or the service of the port, or the port's number."""
    known = F.create_map(*(F.lit(x) for name, number in SERVICES.items() for x in (number, name)))
    return F.coalesce(sni, tls_version, F.when(http, "http"), F.element_at(known, port.cast("int")), F.concat(F.lit("port "), port.cast("string")))


def names(segments: DataFrame, payload: str = "payload") -> DataFrame:
    """(a, b, conversation, sni, tls_version, method, path, http_host, status): what the two directions of each conversation with data begin with."""
    each = with_request(with_hello(streams(segments, payload)))
    said = ("sni", "tls_version", "method", "path", "http_host", "status")
    return each.groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in said))
