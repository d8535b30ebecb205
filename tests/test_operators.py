"""Operators against worked cases and step-by-step replays."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import addresses, packets, predicates, syslog, text
from tracewell.operators import correlate, flows, sequences


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("now,before,limit,want", [(5, 4294967290, None, 11), (5, 100, None, None), (5, 3000000000, 446000000, None), (9, 4, None, 5)])
def test_counter_delta(spark, now, before, limit, want):
    assert one(spark, sequences.counter_delta(F.col("now"), F.col("before"), limit), now=now, before=before) == want


def test_state_fold_compares_with_the_last_kept(spark):
    df = spark.createDataFrame([("a", i, t, "up") for i, t in enumerate([0, 4, 8])], "k string, id int, t bigint, s string")
    assert sorted(r["t"] for r in sequences.drop_repeated_states(df, "k", "s", 5).collect()) == [0, 8]


def test_upper_median(spark):
    rows = [("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("b", None), ("c", 5), ("c", 5), ("c", 1)]
    df = spark.createDataFrame(rows, "k string, x int")
    assert {r["k"]: r["median"] for r in sequences.upper_median(df, "k", "x").collect()} == {"a": 3, "b": 7, "c": 5}


def test_folds_carry_state_over_batches(spark):
    rows = [("a", i, i, "up" if i % 3 else "down") for i in range(500)] + [(None, 1, 1, "up"), (None, 2, 2, "up"), ("b", 5, 1, "up")]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, state string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept = sorted((repr(r["k"]), r["id"]) for r in sequences.drop_repeated_states(df, "k", "state", 10).collect())
        counted = {r["k"]: r["occurrences"] for r in sequences.fold_count(df, "k", F.col("state") == "down", 0, 1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = [("'a'", i) for i in range(500) if i % 3 != 2] + [("'b'", 1), ("None", 1)]
    assert kept == sorted(want)
    assert counted == {"a": 333, None: 2, "b": 1}
    assert sequences.drop_repeated_states(df.limit(0), "k", "state", 10).count() == 0



def test_two_valued_logic(spark):
    df = spark.createDataFrame([(1, None), (2, "abc")], "id int, s string")
    assert [r["id"] for r in df.where(~predicates.word("s", "b")).collect()] == [1]
    assert [r["id"] for r in df.where(predicates.nor(predicates.word("s", "x"), predicates.word("s", "y"))).orderBy("id").collect()] == [1, 2]


def test_fields_with_several_of_a_name(spark):
    rows = [(1, [("a", "7"), ("a", "12")]), (2, [("b", "7")]), (3, None)]
    df = spark.createDataFrame(rows, "id int, f array<struct<key:string,value:string>>")
    ids = lambda c: [r["id"] for r in df.where(c).orderBy("id").collect()]
    assert ids(predicates.field("f", "A", "=", "12")) == [1]
    assert ids(predicates.field("f", "a", "!=", "12")) == [2, 3]
    assert ids(predicates.field("f", "a", ">", "9")) == []  # the first field decides
    assert ids(predicates.field_exists("f", "b")) == [2]


@pytest.mark.parametrize("address,subnet,want", [("10.1.0.255", "10.1.0.77/24", True), ("10.1.1.0", "10.1.0.0/24", False), ("10.1.0.300", "0.0.0.0/0", False), (None, "0.0.0.0/0", False)])
def test_subnet(spark, address, subnet, want):
    assert one(spark, predicates.in_subnet("s", subnet), s=address) is want


@pytest.mark.parametrize("seconds,want", [(45, "45 s"), (200, "3 min 20 s"), (720, "12 min"), (7500, "2 h 5 min"), (97200, "1 d 3 h")])
def test_duration(spark, seconds, want):
    assert one(spark, text.duration_words(F.col("s")), s=seconds) == want


def test_text_forms(spark):
    assert one(spark, text.uptime(F.col("t")), t=8_640_100) == "1d 00:00:01"
    assert one(spark, text.csv_guard(F.col("s")), s="=1+1") == "'=1+1"
    assert one(spark, text.octal_escape(F.col("s")), s="a\x07b\tc\n") == "a#007b\tc#012"
    assert one(spark, addresses.mac("s"), s="AABB.CCDD.EEFF") == "aa:bb:cc:dd:ee:ff"
    assert one(spark, addresses.interface_name("s"), s="Gi1/0/5") == "GigabitEthernet1/0/5"
    assert one(spark, addresses.interface_name("s"), s="eth0") == "eth0"
    assert one(spark, addresses.oid("s") < addresses.oid(F.lit("1.10")), s="1.2") is True


@pytest.mark.parametrize("raw,want", [("5 <1>ab6 <2>cdx", ["<1>ab", "<2>cdx"]), ("<1>a\r\n<2>b\n", ["<1>a", "<2>b"]), ("123", []), ("12 x\n", ["12 x"]), ("\n\n", [])])
def test_frames(spark, raw, want):
    assert one(spark, syslog.frames(F.col("s")), s=raw) == want


@pytest.mark.parametrize("line,received,want", [("Dec 31 23:59:00", "2024-01-01 00:05:00", "2023-12-31 23:59:00"), ("Jan  1 00:01:00", "2023-12-31 23:59:30", "2024-01-01 00:01:00"), ("Mar 3 1:02:03", "2024-03-03 02:00:00", "2024-03-03 01:02:03")])
def test_year_of_a_time_without_one(spark, line, received, want):
    m, d, c = line.split()
    got = one(spark, syslog.rfc3164_micros(F.lit(m), F.lit(d), F.lit(c), F.to_timestamp("r")), r=received)
    assert got == one(spark, F.unix_micros(F.to_timestamp("r")), r=want)


def test_frame_text(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9",), (b"caf\xe9",)], "b binary")
    assert [r["x"] for r in df.select(syslog.frame_text(F.col("b")).alias("x")).collect()] == ["café", "café"]


def test_truncated_and_foreign_frames(spark):
    arp = bytes.fromhex("ffffffffffff0200000000010806" + "0001080006040001020000000001" + "0a000001" + "000000000000" + "0a000002")
    udp = bytes.fromhex("02000000000202000000000108004500002000010000401100000a0000010a000002003500350 00c0000".replace(" ", "") + "61626364")
    df = spark.createDataFrame([(0, b""), (1, arp), (2, udp), (3, udp[:20])], "id int, data binary")
    rows = {r["id"]: r for r in packets.decoded(df).collect()}
    assert rows[1]["arp_request"] and rows[1]["source"] == "10.0.0.1" and rows[1]["destination"] == "10.0.0.2"
    assert (rows[2]["proto"], rows[2]["sport"], rows[2]["payload_length"]) == (17, 53, 4)
    assert rows[0]["source"] is None and rows[3]["sport"] is None


def test_last_before_and_within(spark):
    rng = random.Random(5)
    left = [("k%d" % rng.randrange(3), rng.randrange(100), i) for i in range(60)]
    right = [("k%d" % rng.randrange(3), t, 1000 + t) for t in rng.sample(range(100), 30)]
    a, b = spark.createDataFrame(left, "k string, t bigint, id int"), spark.createDataFrame(right, "k string, t bigint, v int")
    got = {r["id"]: r["found"] for r in correlate.last_before(a, b, ["k"], "v").collect()}
    assert got == {i: max(((bt, v) for bk, bt, v in right if bk == k and bt <= t), default=(0, None))[1] for k, t, i in left}
    pairs = {(r["id"], r["v"]) for r in correlate.within(a, b.withColumnRenamed("t", "other_t"), ["k"], 3, 7).collect()}
    assert pairs == {(i, v) for k, t, i in left for bk, bt, v in right if bk == k and t - 3 <= bt <= t + 7}


def test_last_within(spark):
    rng = random.Random(6)
    some = lambda n, low: [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b", "c"]), rng.randrange(-60, 60), low + rng.randrange(n)) for _ in range(n)]
    left, right = some(150, 0), some(60, 1000)
    a, b = spark.createDataFrame(left, "k int, f string, t bigint, id int"), spark.createDataFrame(right, "k int, f string, other_t bigint, v int")
    want = {}
    for k, f, t, i in left:
        near = [(f is not None and f == g, bt, v) for bk, g, bt, v in right if k is not None and bk == k and t - 5 <= bt <= t]
        want[i] = max(near + [want[i]] if i in want else near, default=None)
        if want[i] is None:
            del want[i]
    got = correlate.last_within(a, b, ["k"], "f", "v", 5).collect()
    assert sorted((r["id"], r["v"]) for r in got) == sorted((i, v) for i, (_, _, v) in want.items())


def replay(rows, idle):
    """Conversations step by step."""
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
        here, there = (r["source"], r["sport"]), (r["destination"], r["dport"])
        key = (min(here, there), max(here, there))
        s = state.setdefault(key, {"n": 0, "last": None, "over": None, "syn": None})
        syn, ack, rst, fin = r["flags"] & 2, r["flags"] & 16, r["flags"] & 4, r["flags"] & 1
        if syn and not ack and s["last"] is not None:
            other = s["syn"] is None or s["syn"][0] != r["seq"]
            if other and (r["t"] - s["last"] > idle or (s["over"] is not None and s["over"] >= (s["syn"][1] if s["syn"] else 0))):
                s["n"] += 1
        if syn and not ack:
            s["syn"] = (r["seq"], r["t"])
        if rst or fin:
            s["over"] = r["t"]
        s["last"] = r["t"]
        f = out.setdefault((key, s["n"]), {"packets": 0, "syns": 0, "rst": False, "synack": False, "more": 0})
        f["packets"] += 1
        f["syns"] += bool(syn and not ack)
        f["rst"] |= bool(rst)
        f["synack"] |= bool(syn and ack)
        f["more"] += not (syn and not ack) and not rst
    return out


def test_flows_equal_a_replay(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        c, s = ("10.0.0.%d" % rng.randrange(4), 50000), ("10.1.0.%d" % rng.randrange(3), 443)
        kind = rng.choice(["syn", "syn", "synack", "data", "rst", "fin"])
        src, dst = (s, c) if kind in ("synack", "rst") else (c, s)
        flags = {"syn": 2, "synack": 18, "data": 24, "rst": 20, "fin": 17}[kind]
        rows.append((i, rng.randrange(400) * 1_000_000 + i, src[0], src[1], dst[0], dst[1], rng.randrange(5) * 100, flags, 1000, 10 if kind == "data" else 0))
    schema = "id int, t bigint, source string, sport bigint, destination string, dport bigint, seq bigint, flags bigint, window bigint, payload_length bigint"
    df = spark.createDataFrame(rows, schema)
    want = replay([r.asDict() for r in df.collect()], 60_000_000)
    got = {}
    for r in flows.flows(df).collect():
        a, b = (r["client"]["ip"], r["client"]["port"]), (r["server"]["ip"], r["server"]["port"])
        got[((min(a, b), max(a, b)), r["conversation"])] = (r["packets"], r["syns"], r["never_answered"], r["refused"])
    assert got == {k: (f["packets"], f["syns"], bool(f["syns"] and not f["synack"] and not f["rst"] and not f["more"]), bool(f["syns"] and not f["synack"] and f["rst"] and not f["more"])) for k, f in want.items()}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_streams_lose_nothing(spark, sf_dir):
    from tracewell.streaming import jobs

    kept = jobs.incremental_filter(spark, sf_dir).count()
    assert kept == spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error' and user_id % 3 = 1").count()
