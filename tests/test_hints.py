"""Hints with known results: the examples of RFC 2579, repeats, text that cannot be shown, hints that cannot be read."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import hints

INTEGERS = [(1234, "d-2", "12.34"), (-5, "d-2", "-0.05"), (0, "d-1", "0.0"), (7, "d", "7"), (-255, "x", "-ff"), (8, "o", "10"), (5, "b", "101"), (-(2**63), "d-3", "-9223372036854775.808"), (5, "d-0", "5"), (5, "z", None), (5, None, None), (None, "d", None)]
OCTETS = [
    (b"\x00\x1a\xff", "1x:", "00:1a:ff"), (b"\x0a\x00\x00\x01\x02\x08", "1d.1d.1d.1d/2d", "10.0.0.1/520"), (b"caf\xc3\xa9", "255a", "café"), (b"ab\x00\x00", "255t", "ab"), (b"a\x00b", "255a", None),
    (b"\xff\xfe", "255t", None), (b"\x02ab\x01c", "*1x-;1d", "61-62;199"), (b"\x00\x05\x06", "*1d,;1d", ";56"), (b"", "1x:", ""), (b"\x01\x02", "0d1x", ""), (b"\x01\x02", "1q", None), (b"\x01", "", None), (b"\x01\x02\x03", "2d-", "258-3"),
    (b"\xff" * 8, "8d", "18446744073709551615"), (b"\x01\x00", "2o", "400"), (None, "1x", None), (b"\x01", "99999d", None), (b"\x03\x01", "*1d.", "1"), (bytes(3000), "1d", "0" * 3000),
]
DATES = [(bytes([7, 0xEA, 9, 23, 14, 5, 3, 4, 43, 7, 0]), "2026-09-23 14:05:03.4 +07:00"), (bytes([7, 0xEA, 9, 23, 14, 5, 3, 4]), "2026-09-23 14:05:03.4"), (bytes([7, 0xEA, 9, 23, 14, 5, 3, 4, 1, 7, 0]), "2026-09-23 14:05:03.4"), (b"\x01", None), (None, None)]


def test_integers(spark):
    got = spark.createDataFrame(INTEGERS, "v long, h string, want string").withColumn("got", hints.integer(F.col("v"), F.col("h"))).collect()
    assert [(r.v, r.h, r.got) for r in got] == INTEGERS


def test_octets(spark):
    rows = spark.createDataFrame(OCTETS, "v binary, h string, want string").withColumn("steps", hints.steps(F.col("h")))
    assert [(r.v, r.h, r.got) for r in rows.withColumn("got", hints.octets(F.col("v"), F.col("steps"))).collect()] == [(bytes(v) if v is not None else None, h, w) for v, h, w in OCTETS]


def test_dates(spark):
    got = spark.createDataFrame(DATES, "v binary, want string").withColumn("got", hints.date_and_time(F.col("v"))).collect()
    assert [r.got for r in got] == [w for _, w in DATES]


@pytest.mark.parametrize("name", ["hint_integers", "hint_octets", "hint_bits"])
def test_registered(name):
    from tracewell import plans

    assert name in plans.queries() and name in plans.oracle_sql()
