"""Capture files, day logs and guarded CSV."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import packets
from tracewell.sources import captures


def capture(order, units, frames):
    magic = {("<", 1): b"\xd4\xc3\xb2\xa1", (">", 1): b"\xa1\xb2\xc3\xd4", ("<", 1000): b"\x4d\x3c\xb2\xa1", (">", 1000): b"\xa1\xb2\x3c\x4d"}[(order, units)]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for ts, data in frames:
        out += struct.pack(order + "IIII", ts // 1_000_000, ts % 1_000_000 * units, len(data), len(data) + 5) + data
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("units", [1, 1000])
def test_capture_files(spark, tmp_path, order, units):
    frames = [(1_700_000_000_123_456 + i, bytes([i]) * (20 + i)) for i in range(7)]
    (tmp_path / "a.pcap").write_bytes(capture(order, units, frames))
    (tmp_path / "torn.pcap").write_bytes(capture(order, units, frames)[:-3])
    (tmp_path / "other.pcap").write_bytes(b"not a capture")
    rows = captures.read_captures(spark, f"{tmp_path}/*.pcap").collect()
    whole = sorted((r["id"], r["ts_us"], bytes(r["data"]), r["length"]) for r in rows if r["file"].endswith("/a.pcap"))
    assert whole == [(i + 1, t, d, len(d) + 5) for i, (t, d) in enumerate(frames)]
    assert sum(r["file"].endswith("torn.pcap") for r in rows) == 6
    assert not any(r["file"].endswith("other.pcap") for r in rows)


def test_capture_round_trip(spark, tmp_path):
    frame = packets.tcp_frame(F.lit(167772161), F.lit(167772162), F.lit(5000), F.lit(443), F.col("id"), F.lit(0), F.lit(2), F.lit("hi").cast("binary"))
    rows = spark.range(5).select((F.col("id") + 1_700_000_000_000_001).alias("ts"), frame.alias("data"))
    made = rows.select("ts", captures.record_bytes("ts", F.octet_length("data"), F.col("data")).alias("r")).orderBy("ts").collect()
    (tmp_path / "b.pcap").write_bytes(captures.file_header() + b"".join(bytes(r["r"]) for r in made))
    back = packets.decoded(captures.read_captures(spark, f"{tmp_path}/b.pcap")).orderBy("id").collect()
    assert [(r["ts_us"], r["seq"], r["dport"], r["source"], r["payload_length"]) for r in back] == [(1_700_000_000_000_001 + i, i, 443, "10.0.0.1", 2) for i in range(5)]


def test_daily_text_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 23, 59), "10.0.0.1", "a\x07b"), (datetime(2024, 1, 2), "10.0.0.2", "=1+1")], "received timestamp, address string, raw string")
    captures.write_daily(rows, f"{tmp_path}/days")
    days = {str(r["day"]): r["value"] for r in spark.read.text(f"{tmp_path}/days").collect()}
    assert days == {"2024-01-01": "2024-01-01T23:59:00.000Z 10.0.0.1 a#007b", "2024-01-02": "2024-01-02T00:00:00.000Z 10.0.0.2 =1+1"}
    captures.write_csv(rows.select("address", "raw"), f"{tmp_path}/csv")
    assert {r["raw"] for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()} == {"a\x07b", "'=1+1"}
