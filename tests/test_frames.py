"""Messages in frames read for all frames at once, against a reader of one message: pointers, rings, long and cut messages."""

import random

import numpy as np
import pyarrow as pa

from tracewell.functions import packets as k


def frame(payload: bytes, sport: int, dport: int) -> bytes:
    size = len(payload)
    ip = bytes.fromhex("4500") + (size + 28).to_bytes(2, "big") + bytes.fromhex("0001000040110000") + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    udp = sport.to_bytes(2, "big") + dport.to_bytes(2, "big") + (size + 8).to_bytes(2, "big") + b"\0\0"
    return bytes.fromhex("0200000000020200000000010800") + ip + udp + payload


def read(frames: list[bytes]) -> dict[str, list]:
    got = k.fields(k.Frames(pa.array(frames, pa.binary())))
    return {n: [v if ok else None for v, ok in zip(values, there)] for n, (values, there) in got.items()}


def name_at(m: bytes, at: int) -> tuple[str | None, int]:
    """By one loop: the name at a place, and where what follows it begins."""
    labels, after, jumps = [], None, 0
    while at < len(m):
        n = m[at]
        if n == 0:
            return ".".join(labels), after if after is not None else at + 1
        if n >= 192:
            jumps += 1
            if at + 1 >= len(m) or jumps > 16:
                return None, -1
            after = at + 2 if after is None else after
            at = (n & 63) << 8 | m[at + 1]
        elif n < 64 and at + 1 + n <= len(m):
            labels.append(m[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n
        else:
            return None, -1
    return None, -1


def answers_of(m: bytes) -> list[str] | None:
    if len(m) < 8 or not int.from_bytes(m[6:8], "big"):
        return None
    out, at = [], 12
    for _ in range(int.from_bytes(m[4:6], "big")):
        name, at = name_at(m, at)
        if name is None:
            return out
        at += 4
    for _ in range(min(8, int.from_bytes(m[6:8], "big"))):
        name, at = name_at(m, at)
        if name is None or at + 10 > len(m):
            return out
        kind, size = int.from_bytes(m[at : at + 2], "big"), int.from_bytes(m[at + 8 : at + 10], "big")
        data = at + 10
        if data + size > len(m):
            return out
        if kind == 1 and size == 4:
            out.append(".".join(map(str, m[data : data + 4])))
        elif kind in (2, 5, 12) and (target := name_at(m, data)[0]) is not None:
            out.append(target)
        at = data + size
    return out


def label(text: str) -> bytes:
    raw = text.encode("latin-1")
    return bytes([len(raw)]) + raw


def message(questions: list[bytes], answers: list[bytes], flags: int = 0x8180) -> bytes:
    head = (7).to_bytes(2, "big") + flags.to_bytes(2, "big") + len(questions).to_bytes(2, "big") + len(answers).to_bytes(2, "big") + bytes(4)
    return head + b"".join(q + bytes.fromhex("00010001") for q in questions) + b"".join(answers)


def record(name: bytes, kind: int, data: bytes) -> bytes:
    return name + kind.to_bytes(2, "big") + bytes.fromhex("000100000e10") + len(data).to_bytes(2, "big") + data


def test_names_and_answers_equal_a_loop():
    plain = label("www") + label("caf\xe9") + label("example") + b"\0"
    back = bytes.fromhex("c00c")
    a = record(back, 1, bytes([10, 0, 0, 9]))
    chain = message([plain], [record(back, 5, label("x") + b"\xc0\x10"), a, record(back, 16, b"\x03txt")] + [a] * 9)
    ring = message([b"\xc0\x0e\xc0\x0c"], [a])
    long_ = message([b"".join(label("a" * 63) for _ in range(40)) + b"\0"], [a])  # 2,560 bytes of name
    deep = message([label("q") + b"\0"] * 3, [record(label("w") + b"\xc0\x0c", 12, label("p") + b"\xc0\x0c")])
    messages = [chain, ring, long_, deep, message([], [record(plain, 1, bytes(4))]), message([plain], []), message([label("x" * 63) + b"\x40bad"], [a]), message([b"\0"], [a]), b"", chain[:13], chain[:40], chain[:61]]
    rng = random.Random(3)
    for _ in range(400):  # bytes changed and messages cut anywhere
        m = bytearray(rng.choice(messages[:6]))
        for _ in range(rng.randrange(3)):
            m[rng.randrange(len(m))] = rng.choice([0, 1, 63, 192, 12, rng.randrange(256)])
        messages.append(bytes(m[: rng.randrange(len(m) + 1)]) if rng.random() < 0.5 else bytes(m))
    ports = [rng.choice([53, 5353, 5355]) for _ in messages]
    got = read([frame(m, p, 40000) for m, p in zip(messages, ports)])
    for i, m in enumerate(messages):
        first = name_at(m, 12)[0] if len(m) >= 8 and int.from_bytes(m[4:6], "big") else None
        assert got["dns_name"][i] == first, (i, m)
        assert got["dns_answers"][i] == answers_of(m), (i, m)
    assert got["dns_answers"][0] == ["x.caf\xe9.example"] + ["10.0.0.9"] * 6 and got["dns_name"][1] is None


def test_answers_of_six_bytes_groups():
    m = message([label("h") + b"\0"], [record(b"\xc0\x0c", 28, bytes.fromhex("fd00" + "00" * 13 + "05"))])
    got = read([frame(m, 53, 40000), frame(m, 54, 40000)])
    assert got["dns_answers"] == [["fd00::5"], None] and got["dns_type"] == [1, None]


def test_dhcp_options_to_the_end():
    head = bytes.fromhex("01010600") + (99).to_bytes(4, "big") + bytes(20) + bytes.fromhex("020000000001") + bytes(202) + bytes.fromhex("63825363")
    tail = bytes([53, 1, 2, 0, 54, 4, 10, 0, 0, 1, 51, 4, 0, 0, 14, 16, 255, 53, 1, 6])
    filler = b"".join(bytes([224 + i, 253]) + bytes(253) for i in range(5))  # 1,275 bytes before what matters
    long_ = filler + tail
    cases = [tail, long_, b"", bytes([53]), bytes([53, 4, 1]), bytes([53, 1, 5, 53, 1, 6]), bytes([54, 3, 1, 2, 3]), bytes(40) + tail]
    got = read([frame(head + c, 67, 68) for c in cases])
    assert got["dhcp_type"] == [2, 2, None, None, None, 5, None, 2]
    assert got["dhcp_lease"] == [3600, 3600, None, None, None, None, None, 3600]
    assert got["dhcp_server"] == ["10.0.0.1", "10.0.0.1", None, None, None, None, None, "10.0.0.1"]


def test_options_of_segments():
    options = bytes([1, 1, 5, 18]) + bytes(16) + bytes([8, 10]) + (77).to_bytes(4, "big") + (66).to_bytes(4, "big")
    options += bytes(-len(options) % 4)
    head = (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(8) + bytes([(5 + len(options) // 4) << 4, 16, 32, 0, 0, 0, 0, 0]) + options
    ip = bytes.fromhex("4500") + (20 + len(head)).to_bytes(2, "big") + bytes.fromhex("0001000040060000") + bytes(8)
    got = read([bytes.fromhex("0200000000020200000000010800") + ip + head])
    assert (got["sack_blocks"], got["ts_value"], got["ts_echo"], got["payload_length"], got["payload_at"]) == ([2], [77], [66], [0], [14 + 20 + len(head)])
    assert read([])["dns_name"] == [] and np.array(read([b""])["sport"]).tolist() == [None]
