"""Hard negatives, decontamination and whitening against brute force, with the odd rows that tables can hold."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import negatives, registry, whitening, winnowing

VECTORS = "vec_id bigint, embedding array<float>, label int"


def odd_vectors(n=260, dim=7, seed=3):
    """Clusters, copies, a hot label, zero vectors, null and non-finite entries, null ids and labels, a repeated id, another length."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.15 * rng.normal(size=dim)
        if i % 9 == 4:
            v = centres[0]
        rows.append((i, [float(np.float32(x)) for x in v], 0 if i % 3 == 0 else int(rng.integers(0, 10))))
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] + rows[6][1][1:], 1)
    rows[10] = (10, [float("nan")] + rows[10][1][1:], 1)
    rows[11] = (11, [float("inf")] + rows[11][1][1:], 1)
    rows[12] = (12, [0.0] * dim, 2)
    rows[13] = (13, rows[13][1], None)
    rows[100] = (100, [0.0] * dim, 4)
    return rows + [(None, rows[1][1], 1), (42, rows[7][1], 3), (300, [1.0, -2.0], 1), (301, [2.0, -1.0], 1), (302, [1.5, -2.0], 2), (303, [1.4, -2.0], 3), (None, None, None)]


def taking_part(rows):
    return [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def loops_of_negatives(rows, anchor, k=5, low=80, high=100):
    """By loops: every anchor against every other row."""
    kept = [(i, [int(np.floor(256 * x)) for x in v], g) for i, v, g in taking_part(rows) if i is not None and g is not None]
    out = []
    for i, v, g in kept:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, h) for j, w, h in kept if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for s, j, _ in [x for x in scored if x[2] == g][:k]:
            inside = [(t, m) for t, m, h in scored if h != g and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(inside)]
    return out


@pytest.mark.parametrize("tree,slice_,block", [(512, 2048, 4096), (4, 16, 40)])
def test_negatives_equal_loops(spark, monkeypatch, tree, slice_, block):
    for name, value in (("TREE", tree), ("SLICE", slice_), ("LEAST_BLOCK", block), ("BLOCK", block), ("ANCHORS", 8 if tree == 4 else 16_384)):
        monkeypatch.setattr(negatives, name, value)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).withColumn("lot", F.lit(1))
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = loops_of_negatives(rows, lambda i: i % 10 == 0)
    # Rows that repeat an id may swap places where scores are equal; ids and scores do not change.
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 200


def test_negatives_of_all_sizes_of_numbers(spark):
    """Products in doubles, in longs, in Python's numbers, and beyond a long."""
    base = [(i, [float(a) for a in np.random.default_rng(i).uniform(-1, 1, 3)], i % 2) for i in range(40)] + [(40, [0.9, -0.9, 0.9], 0)]
    schema = "vec_id bigint, embedding array<double>, label int"
    kinds = []
    for scale in (1.0, 4e5, 6.2e6):
        rows = [(i, [x * scale for x in v], g) for i, v, g in base]
        whole = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
        kinds.append(negatives.Exact(whole, whole).rows.dtype)
        got = negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 4 == 0).collect()
        assert Counter(map(tuple, got)) == Counter(loops_of_negatives(rows, lambda i: i % 4 == 0))
    assert kinds == [float, np.int64, object]
    with pytest.raises(Exception, match="beyond a long"):
        negatives.hard_negatives(spark.createDataFrame([(i, [1e9] * 3, i % 2) for i in range(8)], schema), F.col("vec_id") % 4 == 0).collect()
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 4 == 0).count() == 0


def test_tree_bounds_leave_rows_out():
    """Where vectors have clusters, most candidates of a child are not scored again, and none of the window is lost."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32)) * 300
    rows = (centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 32)) * 6).astype(np.int64)
    anchors = (centres[rng.integers(0, 8, 60)] + rng.normal(size=(60, 32)) * 6).astype(np.int64)
    exact, tree = negatives.Exact(rows, anchors), negatives.Tree(anchors)
    top = (rows @ anchors.T).max(axis=0)
    seen = 0
    for at in range(0, len(rows), negatives.SLICE):
        n = min(negatives.SLICE, len(rows) - at)
        for a, found, scores in negatives.walked(exact, tree, 0, at, lambda a, n=n: np.ones(n, bool), lambda a: (int(0.97 * top[a]), int(top[a]))):
            seen += len(found)
            true = rows[at : at + n] @ anchors[a]
            inside = np.flatnonzero((true >= int(0.97 * top[a])) & (true <= top[a])) + at
            assert set(inside) <= set(found) and (scores == rows[found] @ anchors[a]).all()
    assert seen < 0.35 * len(rows) * len(anchors)


BENCHMARK = "item_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def loops_of_winnowing(docs, items):
    wanted = {}
    for key, text in items:
        w = WORD.findall(low(text))
        size = min(len(w), 10)
        for i in range(len(w) - size + 1 if w and key is not None else 0):
            wanted.setdefault(tuple(w[i : i + size]), set()).add(str(key))
    out = []
    for i, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for size in {len(k) for k in wanted}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in wanted:
                    hit.update(range(at, at + size))
                    found |= wanted[tuple(w[at : at + size])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def odd_texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "DELTA", "ñandú", "Éa", "日本", "x2", "7", "é"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = say(14), say(25)
    items = [(1, passage), (2, other), (3, "one two three"), (4, "solo"), (5, None), (6, ""), (7, "-- !!"), (10, passage + " " + say(3)), (2, say(11)), (None, say(20)), (11, say(10)), (12, say(9))]
    docs = [None, "", " \n", "solo", "Solo, solo!", "one-two.three", "ONE TWO", say(30) + " " + passage, passage.upper().replace("É", "é"), other[:-1], say(9), items[-1][1] + " " + say(2), "\x00solo\x7f", say(6000) + " " + other + " " + say(6000), ("solo " * 500).strip(), items[-4][1]]
    return [(i, t) for i, t in enumerate(docs)] + [(3, "solo"), (3, "two"), (None, passage), (None, "solo"), (7, docs[7])], items


def as_frames(spark):
    docs, items = odd_texts()
    return spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.lit("clash")).withColumn("items", F.lit(0)), spark.createDataFrame(items, BENCHMARK).withColumn("size", F.lit(1))


def digest(found):
    items = F.array_join("items", ",")
    return Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(items.cast("binary"), 256), F.col("n_hit") > 0).collect())


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_winnowing_equals_loops(spark, monkeypatch, most):
    """With everything broadcast, and with everything joined by shuffles."""
    monkeypatch.setattr(winnowing, "BROADCAST", most)
    docs, items = as_frames(spark)
    assert digest(winnowing.contaminated(docs, items)) == Counter(loops_of_winnowing(*odd_texts()))


def test_winnowing_of_empty_tables(spark):
    docs, items = as_frames(spark)
    none = winnowing.contaminated(docs, items.limit(0)).collect()
    assert len(none) == docs.count() and all(r["n_hit"] == 0 and r["items"] == [] for r in none)
    assert winnowing.contaminated(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("name,tables", [("op11_hard_negatives", ["embeddings"]), ("op12_winnowing", ["documents", "benchmark"])])
def test_queries_equal_their_sql(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    names = [c[0] for c in found.description]
    assert set(names) == set(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(found.fetchall())


def test_winnowing_stays_in_the_jvm(spark, sf_dir):
    plan = registry.queries()["op12_winnowing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("low_,high_", [(-50, 50), (0, 1), (-(1 << 40), 1 << 40)])
def test_planes_give_the_exact_cross_products(low_, high_):
    rng = np.random.default_rng(7)
    x = rng.integers(low_, high_, size=(333, 5))
    x[:, 2] = 9  # never changes
    sums, cross = whitening.scatter(x)
    big = x.astype(object)
    assert sums == big.sum(axis=0).tolist() and cross == (big.T @ big).ravel().tolist()


def brute_whitening(rows):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v, _ in taking_part(rows) if len(v)]
    out = []
    for dim in {len(x) for _, x in kept}:
        mine = [(i, x) for i, x in kept if len(x) == dim]
        fit = np.unique(np.array([x for _, x in mine]), axis=0)
        n, s = len(fit), fit.sum(axis=0)
        c = fit - s / n
        values, vectors = np.linalg.eigh(c.T @ c / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        for i, x in mine:
            for k in range(min(dim, 16)):
                live = values[k] > 1e-9 * values[0]
                out.append((i, k + 1, n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), abs((x - s / n) @ vectors[:, k]) / np.sqrt(values[k]) if live else None, values[k] / values.sum() if values.sum() else 0.0))
    return out


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "slice_rows", lambda dim: 50)
    rows = odd_vectors(dim=20) + [(400 + i, [float(i), 1.0, 0.0], 1) for i in range(5)] + [(500, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit("clash")).withColumn("dim", F.lit("clash"))
    got = whitening.whiten(df).select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")).collect()
    want = brute_whitening(rows)
    line = lambda i, k, n, d, w, e: (i, k, n, d, None if w is None else round(abs(w), 6), round(e, 8))
    assert Counter(line(r["id"], r["at"] + 1, r["n"], r["deviation"], r["c"]["whitened"], r["c"]["explained"]) for r in got) == Counter(line(*r) for r in want)
    assert max(r["identity_error"] for r in got) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = registry.queries()["op13_whitening"](spark, sf_dir).toPandas()
    want = {(i, k): (n, d, w, e) for i, k, n, d, w, e in brute_whitening(rows)}
    assert len(got) == len(want)
    for r in got.itertuples():
        n, d, w, e = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, d) and abs(abs(r.whitened) - w) < 1e-6 and abs(r.explained - e) < 1e-9 and r.identity_error < 1e-9
    # One sign for all rows of a component: a component's covariance with the brute force's is one, up to that sign.
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(16)).max() < 1e-6
