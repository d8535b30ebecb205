"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracewell import plans
from tracewell.plans.lines import KINDS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_names_are_registered_once():
    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_lines_without_an_address_are_from_their_event(spark, sf_dir, tmp_path):
    """Two of the kinds of firewalls' lines name no address; a line that names one goes by it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 400")
    events.write.parquet(str(tmp_path / "events.parquet"))
    firewalls = [i for i, k in enumerate(KINDS) if k.vendor in ("fortios", "check-point")]
    silent = [i for i in firewalls if "{address}" not in KINDS[i].message]
    want = {(r["event_id"], r["event_id"] % len(KINDS)) for r in events.collect() if r["event_id"] % len(KINDS) in firewalls and r["user_id"] % 4 == 1}
    assert {kind for _, kind in want} > set(silent) > set()
    got = plans.queries()["filter_parsed_field"](spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in want)


def most_rows(spark, df):
    """df's rows, and the largest count of rows that any step of its plan made."""
    store = spark._jsparkSession.sharedState().statusStore()
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    run = store.executionsList().last().executionId()
    made, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
    metrics = [m for i in range(nodes.size()) for m in (lambda x: [x.apply(k) for k in range(x.size())])(nodes.apply(i).metrics())]
    counts = [made.get(m.accumulatorId()) for m in metrics if m.name() in ("number of output rows", "shuffle records written", "records read")]
    return rows, max(int(c.get().replace(",", "")) for c in counts if c.isDefined())


def test_nearest_prior_builds_no_pairs(spark, tmp_path):
    """Errors and changes of one crowded hour, with equal times, repeated and missing ids, users and times, ends of the hour and times before 1970."""
    hour = 3_600_000_000
    times = [i * 100 for i in range(600)] + [hour, hour + 100, hour + 101, 4 * hour, 4 * hour + 4, 4 * hour + 5, 8 * (hour + 1), 9 * hour, 9 * hour + 9, -hour, -1, -5 * hour, -6 * hour, -4 * (hour + 1), None]
    rows = [(2 * i + k if i % 50 else None if i % 100 else 7, t, None if i % 37 == 1 else (i * 5 + k * (i % 3)) % 21, kind) for i, t in enumerate(times + times[::-3]) for k, kind in enumerate(("error", "signup"))]
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, user_id bigint, event_type string")
    df = df.selectExpr("event_id", "timestamp_micros(t)::timestamp_ntz AS ts", "user_id", "event_type", "1.0D AS value", "'{\"k\": 1}' AS props")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got, most = most_rows(spark, plans.queries()["nearest_prior"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(plans.oracle_sql()["nearest_prior"]).fetchall()
    assert sorted(((r["id"], r["cause"]) for r in got), key=repr) == sorted(want, key=repr)
    assert len(want) > 500 and most <= 2 * len(rows)
