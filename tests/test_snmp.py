"""Notifications against an encoder and a reader of one message; cut and changed messages."""

import random

import pyarrow as pa

from tracewell.functions import snmp as s
from tracewell.functions.packets import Frames


def tlv(tag, body):
    size = len(body)
    return bytes([tag]) + (bytes([size]) if size < 128 else bytes([0x83]) + size.to_bytes(3, "big")) + body


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = b""
    for part in [first * 40 + second, *rest]:
        groups = [part & 127]
        while part := part >> 7:
            groups.insert(0, part & 127 | 128)
        out += bytes(groups)
    return out


def number(n, tag=2):
    return tlv(tag, n.to_bytes(max(1, (n.bit_length() + 8) // 8), "big", signed=True))


def trap(binds, kind=0xA7, version=1):
    pdu = number(5) + number(0) + number(0) + tlv(0x30, b"".join(tlv(0x30, tlv(6, oid(o)) + v) for o, v in binds))
    return tlv(0x30, number(version) + tlv(4, b"public") + tlv(kind, pdu))


def read(messages):
    got = s.fields(Frames(pa.array(messages, pa.binary())))
    return pa.table(got).to_pylist()


HEAD = [("1.3.6.1.2.1.1.3.0", number(77, 0x43)), ("1.3.6.1.6.3.1.1.4.1.0", tlv(6, oid("1.3.6.1.6.3.1.1.5.3")))]
MORE = [
    ("1.3.6.1.2.1.2.2.1.1.70000", number(-129)), ("2.999.3", number(2**64 - 1, 0x46)), ("1.0.8802", number(2**31, 0x41)), ("0.39.1", tlv(4, b"text\0")), ("1.3.6.1.4.1.1", tlv(4, bytes([2, 5]))),
    ("1.3.6.1.4.1.2", tlv(4, "Zürich".encode())), ("1.3.6.1.4.1.3", tlv(4, b"")), ("1.3.6.1.4.1.4", tlv(5, b"")), ("1.3.6.1.4.1.5", tlv(0x40, bytes([10, 1, 2, 3]))), ("1.3.6.1.4.1.6", tlv(4, b"x" * 40_000)),
    ("1.3.6.1.4.1.7", tlv(6, oid("1.3.6.1.4.1.4294967295"))), ("1.3.6.1.4.1.8", tlv(0x81, b"")), ("1.3.6.1.4.1.9", tlv(6, b"\x2b\x86")), ("1.3.6.1.4.1.10", number(0)), ("1.3.6.1.4.1.11", number(200, 0x42)),
]
WANTED = ["-129", str(2**64 - 1), str(2**31), "text", "02 05", "Zürich", "", None, "10.1.2.3", "x" * 40_000, "1.3.6.1.4.1.4294967295", None, None, "0", "200"]


def test_values_of_all_types():
    got = read([trap(HEAD + MORE), trap(HEAD, 0xA6), trap(MORE[:1])])
    assert [b["oid"] for b in got[0]["binds"]] == [o for o, _ in MORE] and [b["value"] for b in got[0]["binds"]] == WANTED
    assert (got[0]["trap_oid"], got[0]["uptime"], got[0]["kind"], got[0]["version"], got[0]["community"], got[0]["agent"]) == ("1.3.6.1.6.3.1.1.5.3", 77, "trap", 2, "public", None)
    assert got[1]["kind"] == "inform" and got[1]["binds"] == [] and got[2]["trap_oid"] is None


def test_version_one_becomes_two():
    def one(generic, specific, agent):
        pdu = tlv(6, oid("1.3.6.1.4.1.9999")) + tlv(0x40, agent) + number(generic) + number(specific) + number(9, 0x43) + tlv(0x30, b"")
        return tlv(0x30, number(0) + tlv(4, b"c") + tlv(0xA4, pdu))

    got = read([one(2, 0, bytes([10, 0, 0, 1])), one(6, 300, bytes(4))])
    assert [g["trap_oid"] for g in got] == ["1.3.6.1.6.3.1.1.5.3", "1.3.6.1.4.1.9999.0.300"] and [g["version"] for g in got] == [1, 1]
    assert [[b["value"] for b in g["binds"]] for g in got] == [["10.0.0.1", "1.3.6.1.4.1.9999"], ["1.3.6.1.4.1.9999"]]


def test_what_is_no_notification():
    whole = trap(HEAD + MORE[:3])
    bad = [b"", b"\x30", whole[:-1], trap(HEAD, 0xA0), trap(HEAD, version=3), b"\x30\x80" + whole[2:], b"\x31" + whole[1:], None]
    got = s.fields(Frames(pa.array(bad, pa.binary()).fill_null(b"")))
    assert all(v is None for column in got.values() for v in column.to_pylist())


def test_changed_bytes_do_no_harm():
    rng = random.Random(5)
    whole = trap(HEAD + MORE[:9])
    messages = []
    for _ in range(500):
        m = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            m[rng.randrange(len(m))] = rng.randrange(256)
        messages.append(bytes(m[: rng.randrange(len(m) + 1)]) if rng.random() < 0.3 else bytes(m))
    together, alone = read(messages), [read([m])[0] for m in messages]
    assert together == alone and any(g["kind"] for g in together) and any(g["kind"] is None for g in together)


def test_many_var_binds():
    got = read([trap(HEAD + [("1.3.6.1.4.1.5", number(i)) for i in range(1200)])])[0]
    assert len(got["binds"]) == 998 and got["binds"][-1]["value"] == "997"  # 1,000 with the two of the head
