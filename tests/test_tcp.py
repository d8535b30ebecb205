"""Verdicts, waits and findings on captures with known outcomes, and long conversations cut by time."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import flows, tcp

SEGMENTS = "id long, t long, source string, sport long, destination string, dport long, seq long, ack long, flags long, window long, payload_length long, sack_blocks long"
SYN, FIN, RST, PSH, ACK = 2, 1, 4, 8, 16


class Talk:
    """Segments of one conversation; sequence numbers follow from what was sent."""

    def __init__(self, rows, client, port, server, to, begin, first=1000, second=5000):
        self.rows, self.ends, self.begin, self.next = rows, ((client, port), (server, to)), begin, [first, second]

    def say(self, t, side, flags=ACK, n=0, seq=None, ack=None, window=8192, sack=0):
        here, there = self.ends[side], self.ends[1 - side]
        own = self.next[side] if seq is None else seq
        ack = (self.next[1 - side] if ack is None else ack) if flags & ACK else 0
        self.rows.append((len(self.rows) + 1, int((self.begin + t) * 1e6), *here, *there, own % 2**32, ack % 2**32, flags, window, n, sack))
        if seq is None:
            self.next[side] += n + (1 if flags & (SYN | FIN) else 0)
        return len(self.rows)

    def shake(self, rtt):
        self.say(0, 0, SYN)
        self.say(rtt, 1, SYN | ACK)
        self.say(rtt + 0.0001, 0)


def golden(first=1000):
    """Six conversations: healthy, lossy, unanswered, slow, refused, healthy; and what the lossy one's segments are."""
    rows, names = [], {}
    h = Talk(rows, "10.1.20.15", 51234, "93.184.216.34", 80, 0, first)
    h.shake(0.056)
    h.say(0.0562, 0, PSH | ACK, 142)
    h.say(0.1522, 1, ACK, 1460)
    for k in range(10):
        h.say(0.153 + k * 0.0004, 1, ACK, 1460)
        if k % 2:
            h.say(0.154 + k * 0.0004, 0)
    h.say(0.2102, 1, FIN | ACK)
    h.say(0.2104, 0)
    lossy = Talk(rows, "10.1.20.15", 51240, "10.1.30.8", 443, 0.4, first)
    lossy.shake(0.012)
    lossy.say(0.0125, 0, PSH | ACK, 517)
    lossy.say(0.026, 1, PSH | ACK, 1200)
    lossy.say(0.028, 0, PSH | ACK, 80)
    for k in range(4):
        lossy.say(0.042 + k * 0.0005, 1, ACK, 1460)
    lost = lossy.next[1]
    lossy.next[1] += 1460
    lossy.say(0.0445, 0, ack=lost)
    for k in range(3):
        i = lossy.say(0.045 + k * 0.0005, 1, ACK, 1460)
        names |= {i: "segment before not captured"} if k == 0 else {}
        names[lossy.say(0.0452 + k * 0.0005, 0, ack=lost)] = "duplicate ACK"
    names[lossy.say(0.058, 1, ACK, 1460, seq=lost)] = "fast retransmission"
    names[lossy.say(0.26, 1, ACK, 1460, seq=lost)] = "retransmission"
    names[lossy.say(0.76, 1, ACK, 1460, seq=lost)] = "retransmission"
    lossy.say(0.772, 0)
    names[lossy.say(0.78, 1, ACK, 1460, seq=lost)] = "spurious retransmission"
    silent = Talk(rows, "10.1.20.15", 51250, "10.1.40.20", 22, 0.9, first)
    silent.say(0, 0, SYN, seq=1000)
    for t in (1.0, 3.0):
        names[silent.say(t, 0, SYN, seq=1000)] = "retransmission"
    slow = Talk(rows, "10.1.20.15", 51262, "10.1.30.12", 8080, 1.2, first)
    slow.shake(0.004)
    slow.say(0.0045, 0, PSH | ACK, 380)
    slow.say(0.0085, 1)
    slow.say(4.21, 1, PSH | ACK, 820)
    slow.say(4.214, 0)
    refused = Talk(rows, "10.1.20.15", 51270, "10.1.30.9", 8443, 1.5, first)
    refused.say(0, 0, SYN)
    refused.say(0.0011, 1, RST | ACK, seq=0)
    calm = Talk(rows, "10.1.20.15", 51280, "17.253.144.10", 443, 2.0, first)
    calm.shake(0.018)
    calm.say(0.0182, 0, PSH | ACK, 517)
    calm.say(0.037, 1, PSH | ACK, 2800)
    return rows, names


def frame(spark, rows):
    return flows.segments(spark.createDataFrame(rows, SEGMENTS))


@pytest.mark.parametrize("most, first", [(1000, 1000), (3, 2**32 - 400)])
def test_golden_captures(spark, monkeypatch, most, first):
    """Also with all conversations cut every 50 ms, and with numbers that wrap."""
    monkeypatch.setattr(tcp, "SLICE", 50_000)
    rows, names = golden(first)
    seen = tcp.with_client(tcp.verdicts(frame(spark, rows), most)).cache()
    assert {r["id"]: r["verdict"] for r in seen.where("verdict is not null").collect()} == names
    answers = {(r["a"]["ip"], r["b"]["ip"], r["turn"]): r["wait"] for r in tcp.waits(seen, most).collect()}
    assert answers == {("10.1.20.15", "93.184.216.34", 1): 96000, ("10.1.20.15", "10.1.30.8", 1): 13500, ("10.1.20.15", "10.1.30.8", 2): 14000, ("10.1.20.15", "10.1.30.12", 1): 4205500, ("10.1.20.15", "17.253.144.10", 1): 18800}
    facts = {r["server"]["ip"]: r for r in tcp.conversation_facts(seen, tcp.waits(seen, most)).collect()}
    assert (facts["10.1.30.8"]["resent"], facts["10.1.30.8"]["spurious"], facts["10.1.30.8"]["duplicate_acks"], facts["10.1.30.8"]["handshake"]) == (4, 1, 3, 12000)
    assert not facts["10.1.30.9"]["early_reset"] and facts["10.1.30.12"]["longest_wait"] == 4205500
    found = {(r["rule"], r["server"]) for r in tcp.endpoint_findings(tcp.conversation_facts(seen, tcp.waits(seen, most))).collect()}
    assert found == {("tcp.slowResponse", "10.1.30.12")}


def test_probes_windows_and_order(spark):
    rows, names = [], {}
    t = Talk(rows, "10.0.0.1", 40000, "10.0.0.2", 443, 0)
    t.shake(0.03)
    t.say(0.04, 0, PSH | ACK, 100)
    hole = t.next[1]
    t.next[1] += 500
    names[t.say(0.06, 1, ACK, 500)] = "segment before not captured"
    names[t.say(0.0605, 1, ACK, 500, seq=hole)] = "out of order"  # soon after the other side's last, within the round trip
    t.say(0.08, 0)
    names[t.say(1.0, 0, seq=t.next[0] - 1)] = "keep-alive"
    names[t.say(1.01, 1)] = "keep-alive ACK"
    closed = t.say(2.0, 0, window=0)
    names[t.say(3.0, 1, ACK, 1, seq=t.next[1])] = "zero-window probe"
    names[t.say(3.01, 0, window=0)] = "probe ACK"
    names[t.say(4.0, 0, window=4096)] = "window update"
    t.say(4.01, 1, ACK, 700)
    names[t.say(4.02, 0, window=4096, ack=t.next[1] + 900)] = "unseen segment acknowledged"
    names[t.say(4.03, 0, window=5000, ack=t.next[1] + 900, sack=1)] = "duplicate ACK"  # with SACK blocks an update is one
    got = tcp.verdicts(frame(spark, rows)).collect()
    assert {r["id"]: r["verdict"] for r in got if r["verdict"]} == names
    assert {r["id"] for r in got if r["zero_window"]} == {closed, closed + 2}


def test_resets_and_handshakes(spark):
    rows = []
    for port in range(3):
        t = Talk(rows, "10.0.0.1", 40000 + port, "10.0.0.2", 443, port)
        t.shake(0.4)
        t.say(0.5, 0, PSH | ACK, 100)
        t.say(0.6, 1, RST | ACK)
    seen = tcp.with_client(tcp.verdicts(frame(spark, rows)))
    found = {r["rule"]: (r["severity"], r["count"]) for r in tcp.endpoint_findings(tcp.conversation_facts(seen, tcp.waits(seen))).collect()}
    assert found == {"tcp.serverReset": (3, 3), "tcp.slowHandshake": (2, 3)}


def test_empty(spark):
    none = frame(spark, []).where(F.lit(True))
    assert tcp.verdicts(none).count() == 0 and tcp.waits(tcp.with_client(tcp.verdicts(none))).count() == 0
