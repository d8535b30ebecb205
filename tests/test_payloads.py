"""Streams put together from segments, and the names in them, against loops; holes, overlaps, cut and changed hellos."""

import random

import pyarrow as pa

from tracewell.functions.packets import Frames
from tracewell.operators import flows, payloads

SEGMENTS = "id long, t long, source string, sport long, destination string, dport long, seq long, ack long, flags long, window long, payload_length long, payload binary"


def sized(width, body):
    return len(body).to_bytes(width, "big") + body


def hello(name=b"www.example.org", versions=(), more=b"", old=0x0303):
    ext = more
    if versions:
        ext += b"\0\x2b" + sized(2, sized(1, b"".join(v.to_bytes(2, "big") for v in versions)))
    if name is not None:
        ext += b"\0\0" + sized(2, sized(2, b"\0" + sized(2, name)))
    body = old.to_bytes(2, "big") + bytes(32) + sized(1, b"s" * 32) + sized(2, b"\x13\x01") + sized(1, b"\0") + sized(2, ext)
    return b"\x16\x03\x01" + sized(2, b"\x01" + sized(3, body))


def read(streams):
    name, version = payloads.hello_fields(Frames(pa.array(streams, pa.binary())))
    return list(zip(name.tolist(), version.tolist()))


def test_hellos():
    grease = b"\x0a\x0a" + sized(2, b"") + b"\0\x15" + sized(2, bytes(500))
    whole = hello(versions=(0x0A0A, 0x0304, 0x0303), more=grease)
    cases = [whole, hello(), hello(None), hello(old=0x0301), whole[:-3], whole[:20], b"", b"GET / HTTP/1.1", b"\x17" + whole[1:], hello(name=b"")]
    assert read(cases) == [("www.example.org", "TLS 1.3"), ("www.example.org", "TLS 1.2"), (None, "TLS 1.2"), ("www.example.org", "TLS 1.0"), (None, "TLS 1.3"), (None, None), (None, None), (None, None), (None, None), ("", "TLS 1.2")]


def test_changed_hellos_do_no_harm():
    rng = random.Random(2)
    whole = hello(versions=(0x0304,))
    changed = []
    for _ in range(400):
        m = bytearray(whole)
        for _ in range(rng.randrange(1, 5)):
            m[rng.randrange(len(m))] = rng.randrange(256)
        changed.append(bytes(m[: rng.randrange(len(m) + 1)]) if rng.random() < 0.4 else bytes(m))
    assert read(changed) == [read([m])[0] for m in changed]


def joined(parts):
    """By a loop: parts (place, time, bytes) up to the first hole; the part that begins first has the bytes, of equal ones the first sent."""
    out = b""
    for at, _, data in sorted(parts, key=lambda p: p[:2]):
        if at > len(out):
            return out
        out += data[max(0, len(out) - at) :]
    return out


def test_streams_equal_a_loop(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for port in range(40):
        base = rng.choice([1000, 2**32 - 50])
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 400)))
        parts = []
        for _ in range(rng.randrange(1, 14)):
            a = rng.randrange(len(text))
            data = text[a : a + rng.randrange(1, 120)]
            parts.append([a, 0, data if rng.random() < 0.9 else bytes(len(data))])  # resent with other bytes
        at = 0
        while rng.random() < 0.97 and at < len(text):
            n = rng.randrange(1, 90)
            parts.append([at, 0, text[at : at + n]])
            at += n
        rng.shuffle(parts)
        rows.append((len(rows), port * 1000, "10.0.0.1", 20000 + port, "10.0.0.2", 443, base, 0, 2, 8192, 0, b""))
        for j, p in enumerate(parts):
            p[1] = j
            rows.append((len(rows), port * 1000 + 1 + j, "10.0.0.1", 20000 + port, "10.0.0.2", 443, (base + 1 + p[0]) % 2**32, 0, 16, 8192, len(p[2]), p[2]))
        wanted[20000 + port] = joined(parts)
    df = flows.segments(spark.createDataFrame(rows, SEGMENTS))
    got = {r["a"]["port"]: bytes(r["stream"]) for r in payloads.streams(df).collect()}
    assert got == {p: s for p, s in wanted.items() if s}


def test_requests_and_applications(spark):
    texts = [b"GET /a HTTP/1.1\r\nAccept: */*\r\nhost: h.example \r\n\r\n", b"POST /b HTTP/1.0\r\n\r\nHost: body.example\r\n", b"HTTP/1.1 503 Busy\r\n\r\n", b"GETTING started", b"", None]
    got = payloads.with_request(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, stream binary")).orderBy("id").collect()
    assert [(r["method"], r["path"], r["http_host"], r["status"]) for r in got] == [("GET", "/a", "h.example", None), ("POST", "/b", None, None), (None, None, None, 503), (None,) * 4, (None,) * 4, (None,) * 4]
    assert payloads.names(flows.segments(spark.createDataFrame([], SEGMENTS))).count() == 0
