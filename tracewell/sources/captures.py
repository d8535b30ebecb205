"""Capture files (pcap) as tables and back, logs by day, guarded CSV.

Files are read by Spark, whole, one row each; records are cut off in the tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_guard, octal_escape

#: The four magic numbers, as (byte order, units of time a microsecond).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
MOST_CAPTURED = 262_144
PACKETS = "file string, id long, ts_us long, length long, captured long, link_type int, data binary"


def records(content: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(time in microseconds, length, captured length, link type, bytes) of each whole record; a torn end is left out."""
    if content[:4] not in MAGIC or len(content) < 24:
        return
    order, units = MAGIC[content[:4]]
    link = struct.unpack(order + "I", content[20:24])[0] & 0xFFFF
    at = 24
    while at + 16 <= len(content):
        seconds, fraction, captured, length = struct.unpack(order + "IIII", content[at : at + 16])
        if captured > MOST_CAPTURED or at + 16 + captured > len(content):
            return
        yield seconds * 1_000_000 + fraction // units, length, captured, link, content[at + 16 : at + 16 + captured]
        at += 16 + captured


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The packets of all capture files at path, numbered from 1 in each file."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held: list[tuple] = []
                for n, (ts, length, captured, link, data) in enumerate(records(content), 1):
                    held.append((file, n, ts, length, captured, link, data))
                    if len(held) == 5000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PACKETS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ("file", "id", "ts_us", "length", "captured", "link_type", "data")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def record_bytes(ts_us, length, data):
    """A record of a capture file in network order, as a column; a file is its header and its packets' records in order of time."""
    four = lambda n: F.lpad(F.hex(n), 8, "0")
    ts = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    left = F.pmod(ts, F.lit(1_000_000))
    return F.unhex(F.concat(four(((ts - left) / 1_000_000).cast("bigint")), four(left), four(F.octet_length(data)), four(length), F.hex(data)))


def file_header(link_type: int = 1) -> bytes:
    return b"\xa1\xb2\xc3\xd4" + struct.pack(">HHiIII", 2, 4, 0, 0, MOST_CAPTURED, link_type)


def write_daily(lines: DataFrame, path: str) -> None:
    """Lines (received, address, raw) as text by day: time, address and the line with its controls escaped."""
    stamp = F.date_format("received", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.concat_ws(" ", stamp, "address", octal_escape(F.col("raw")))
    lines.select(F.to_date("received").alias("day"), text.alias("value")).write.partitionBy("day").mode("append").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with quotes where they are needed and no cell that a spreadsheet would run."""
    guarded = [csv_guard(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in rows.schema.fields]
    rows.select(*guarded).write.option("header", True).option("escape", '"').option("lineSep", "\n").csv(path)
