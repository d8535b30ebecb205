"""Hard negatives by bounds along spanning trees of anchors.

Entries become integers, floor(SCALE * x), and a row's score is its integer inner product with the anchor. Anchors go to trees of up to ``TREE``: the
minimum spanning tree of their vectors. A task walks each tree from its root, slice by slice of its candidates. The root scores the whole slice. At a child, a
candidate's score lies within the edge's length times the candidate's norm of its score (or of its bounds) at the parent; only candidates whose bounds overlap the window that
is asked for are scored again, and all others hand their wider bounds on. What is returned is exact: bounds only say what need not be scored.

Two walks follow one another. The first finds positives, and its window opens at the least of the positives that a task holds so far. The second finds
negatives: a positive with score p asks for scores from ceil(LOW * p / 100) to floor(HIGH * p / 100), and from the least that is held for it on once the task holds enough; an anchor's window is the union of its positives' ones.
Both walks meet all candidates in blocks of up to ``BLOCK`` rows and ``BYTES``, and anchors in lots that are ordered by the signs of their entries, so that
a tree's edges are short where vectors have structure. Each unit returns a few rows for an anchor, and these meet in a window with a limit that Spark also applies before it shuffles.

Rows with a null id, label or vector, or with null or non-finite components, take no part. Only vectors of one length meet. Other rows than an anchor's are those of another id;
rows that repeat an id are candidates each. Anchors alike in id, label and vector are one; such that share an id only are anchors each. Ties go to the smaller id. With fewer rows than asked for all are returned; an anchor without positives
gives no row, nor does a positive without negatives (so one with a score below zero, whose window is empty). Scores beyond a long raise an error. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, table, written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Anchors in a tree, candidates in a slice: bounds of one tree on one slice are held at a time.
TREE, SLICE = 512, 2048
#: Rows and bytes of a block, anchors of a lot at most; the least that a table is cut into, so that a small one has tasks enough.
BLOCK, BYTES, ANCHORS, LEAST_BLOCK = 32_768, 32 << 20, 16_384, 4096
#: Signs that anchors are ordered by.
SIGNS = 24


def usable(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(id, label, y, dim, is_anchor): the rows that take part, with integers."""
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = df.where(F.col(key).isNotNull() & label.isNotNull() & v.isNotNull() & F.forall(v, number))
    fits = F.forall(v, lambda x: F.abs(x.cast("double") * scale) < float(1 << 62))
    y = F.when(fits, F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))).otherwise(F.raise_error(F.lit("a component is too large to be an integer of 62 bits")).cast("array<bigint>"))
    return kept.select(F.col(key).alias("id"), label.alias("label"), y.alias("y"), F.size(v).alias("dim"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))


class Exact:
    """Exact inner products of integer matrices: in doubles where no product can reach 2**53, else in longs, else in Python's numbers."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        length = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1))
        self.norms, self.anchor_norms = length(rows), length(anchors)
        most = float(self.norms.max(initial=0)) * float(self.anchor_norms.max(initial=0)) * 1.001
        kind = float if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        self.rows, self.anchors = rows.astype(kind), anchors.astype(kind)

    def scores(self, rows: np.ndarray, anchor: int) -> np.ndarray:
        got = rows @ self.anchors[anchor]
        if got.dtype == object and len(got) and max(abs(v) for v in got) >= 1 << 63:
            raise OverflowError("a score is beyond a long")
        return got.astype(np.int64)


class Tree:
    """A minimum spanning tree of some anchors: an order in which parents come first, each one's parent and edge."""

    def __init__(self, vectors: np.ndarray):
        v = vectors.astype(float)
        n = len(v)
        self.order, self.parent, self.edge = [0], np.full(n, -1), np.zeros(n)
        apart = lambda i: np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        nearest, via = apart(0), np.zeros(n, int)
        out = np.ones(n, bool)
        out[0] = False
        for _ in range(n - 1):
            i = int(np.argmin(np.where(out, nearest, np.inf)))
            self.order.append(i)
            self.parent[i], self.edge[i] = via[i], nearest[i]
            out[i] = False
            d = apart(i)
            closer = out & (d < nearest)
            nearest[closer], via[closer] = d[closer], i


def walked(exact: Exact, tree: Tree, first: int, at: int, wanted, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, scores) of one slice, which begins at row `at`, for each anchor of a tree, which begins at anchor `first`.

    wanted(anchor) says which rows of the slice matter, window(anchor) what scores do; all that matter within the window are yielded, and perhaps more."""
    rows = exact.rows[at : at + SLICE]
    norms = exact.norms[at : at + SLICE]
    low, high = np.zeros((len(tree.order), len(rows))), np.zeros((len(tree.order), len(rows)))
    slack = 0.5 + 1e-9 * float(norms.max(initial=0)) * float(exact.anchor_norms.max(initial=0))
    for i in tree.order:
        p = tree.parent[i]
        if p < 0:
            need = np.arange(len(rows))
        else:
            reach = norms * (tree.edge[i] * (1 + 1e-12))
            np.subtract(low[p], reach, out=low[i])
            np.add(high[p], reach, out=high[i])
            least, most = window(first + i)
            need = np.flatnonzero(wanted(first + i) & (high[i] >= least - slack) & (low[i] <= most + slack)) if least <= most else np.zeros(0, int)
        if 2 * len(need) > len(rows):  # a whole product is cheaper than to pick rows, and its scores tighten the children's bounds
            need = np.arange(len(rows))
            got = exact.scores(rows, first + i)
        else:
            got = exact.scores(rows[need], first + i)
        low[i, need] = high[i, need] = got
        inside = wanted(first + i)[need]
        yield first + i, need[inside] + at, got[inside]


def units(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows by (dim, block, lot) and anchors by (dim, block, lot): every lot meets every block of its length."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    signs = lambda: F.concat_ws("", F.transform(F.slice("y", 1, SIGNS), lambda x: F.when(x < 0, "0").otherwise("1")))
    # Signs first, a hash after them: copies of a vector are dealt out as well as others.
    ordered = anchors.withColumn("place", F.shiftleft(F.coalesce(F.conv(signs(), 2, 10).cast("long"), F.lit(0).cast("long")), 20) + F.pmod(F.xxhash64("akey"), F.lit(1 << 20)))
    asked = ordered.groupBy("dim").agg(F.count("*").alias("m"), F.percentile_approx("place", [i / 64 for i in range(1, 64)], 10_000).alias("cuts"))
    most = F.greatest(F.least(F.lit(BLOCK), F.floor(BYTES / (8 * F.greatest("dim", F.lit(1))))), F.lit(1))
    block = F.least(most, F.greatest(F.ceil(F.col("n") / 6), F.lit(LEAST_BLOCK)))
    lot = F.least(most, F.lit(ANCHORS))
    plan = sizes.join(asked, "dim").select("dim", "cuts", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / lot).cast("int").alias("lots"))
    plan = F.broadcast(plan)  # a row for each length of vectors
    mine = rows.join(plan, "dim").withColumn("block", F.pmod(F.xxhash64("id", "y"), F.col("blocks")).cast("int"))
    # The 64 parts that the cuts make are dealt to lots in order; where there are more lots, each part has several.
    part = F.aggregate("cuts", F.lit(0), lambda n, c: n + (c < F.col("place")).cast("int"))
    deep = F.greatest(F.ceil(F.col("lots") / 64).cast("int"), F.lit(1))
    lot_of = F.floor((part * deep + F.pmod(F.xxhash64("akey"), deep)) * F.col("lots") / (64 * deep)).cast("int")
    theirs = ordered.join(plan, "dim").withColumn("lot", F.when(F.col("lots") > 1, lot_of).otherwise(0))
    left = mine.select(*(F.col(c).alias(c) for c in ("dim", "block", "id", "label", "y")), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))  # names of its own: both sides are read from one table
    right = theirs.drop("cuts", "lots").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left, right


def matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dim)


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id; only rows that may be among them are sorted."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Unit:
    """A block's candidates and a lot's anchors, cut into trees."""

    def __init__(self, held: pa.Table, asking: pa.Table, dim: int):
        asking = asking.take(pa.array(np.lexsort((asking.column("akey").to_numpy(), asking.column("place").to_numpy()))))
        self.asking = asking
        self.ids = held.column("id").to_numpy()
        names = {v: i for i, v in enumerate(dict.fromkeys([*held.column("label").to_pylist(), *asking.column("label").to_pylist()]))}
        code = lambda t: np.array([names[v] for v in t.column("label").to_pylist()], int)
        self.labels, self.own_labels, self.own = code(held), code(asking), asking.column("id").to_numpy()
        anchors = matrix(asking, dim)
        self.exact = Exact(matrix(held, dim), anchors)
        self.trees = [(at, Tree(anchors[at : at + TREE])) for at in range(0, len(anchors), TREE)]

    def walk(self, same: bool, window):
        for at in range(0, len(self.ids), SLICE):
            ids, labels = self.ids[at : at + SLICE], self.labels[at : at + SLICE]
            wanted = (lambda a: (labels == self.own_labels[a]) & (ids != self.own[a])) if same else (lambda a: labels != self.own_labels[a])
            for first, tree in self.trees:
                yield from walked(self.exact, tree, first, at, wanted, window)


def positives(unit: Unit, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the ids and scores of its k best rows of the same label in this block."""
    held = [(np.zeros(0, unit.ids.dtype), np.zeros(0, np.int64))] * len(unit.own)
    least = lambda a: int(held[a][1][-1]) if len(held[a][1]) >= k else -np.inf
    for a, rows, scores in unit.walk(True, lambda a: (least(a), np.inf)):
        if len(rows):
            ids, scores = np.r_[held[a][0], unit.ids[rows]], np.r_[held[a][1], scores]
            top = best_rows(ids, scores, k)
            held[a] = ids[top], scores[top]
    return held


def negatives(unit: Unit, windows: list[list[tuple[int, int]]], k: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each anchor and each of its windows (least, most) the ids and scores of its k best rows of another label."""
    none = (np.zeros(0, unit.ids.dtype), np.zeros(0, np.int64))
    held = [[none] * len(w) for w in windows]

    def window(a: int):
        lows = [max(low, int(h[1][-1]) if len(h[1]) >= k else low) for (low, _), h in zip(windows[a], held[a])]
        return (min(lows), max(high for _, high in windows[a])) if lows else (0, -1)

    for a, rows, scores in unit.walk(False, window):
        for j, (low, high) in enumerate(windows[a]):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                ids, some = np.r_[held[a][j][0], unit.ids[rows[inside]]], np.r_[held[a][j][1], scores[inside]]
                top = best_rows(ids, some, k)
                held[a][j] = ids[top], some[top]
    return held


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where anchor holds, against all rows."""
    rows = written(usable(df, key, vector, F.col(label) if isinstance(label, str) else label, anchor, scale))
    kind, label_kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    anchors = rows.where("is_anchor").select("id", "label", "y", "dim").distinct().withColumn("akey", F.xxhash64("id", "label", "y"))
    candidates = rows.select("id", "label", "y", "dim")
    empty = lambda names: pa.table({n: pa.array([], t) for n, t in names.items()})

    def first(key_, held: pa.Table, asking: pa.Table) -> pa.Table:
        names = {"anchor_id": held.schema.field("id").type, "akey": pa.int64(), "positive_id": held.schema.field("id").type, "positive_score": pa.int64()}
        if not (held.num_rows and asking.num_rows):
            return empty(names)
        unit = Unit(held, asking, key_[0].as_py())
        found = positives(unit, n_positives)
        times = [len(ids) for ids, _ in found]
        out = [np.repeat(unit.own, times), np.repeat(unit.asking.column("akey").to_numpy(), times), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
        release()
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(names.items(), out)})

    left, right = units(candidates, anchors)
    near = left.groupBy("dim", "block", "lot").cogroup(right.groupBy("dim", "block", "lot")).applyInArrow(first, f"anchor_id {kind}, akey long, positive_id {kind}, positive_score long")
    order = Window.partitionBy("anchor_id", "akey").orderBy(F.desc("positive_score"), "positive_id")
    kept = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n_positives)
    lists = written(kept.groupBy("anchor_id", "akey").agg(F.array_sort(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("p")))
    with_positives = anchors.join(lists.withColumnRenamed("anchor_id", "id"), ["id", "akey"])

    def second(key_, held: pa.Table, asking: pa.Table) -> pa.Table:
        id_type = held.schema.field("id").type
        names = {"anchor_id": id_type, "akey": pa.int64(), "at": pa.int32(), "positive_id": id_type, "positive_score": pa.int64(), "negative_id": id_type, "negative_score": pa.int64()}
        if not (held.num_rows and asking.num_rows):
            return empty(names)
        unit = Unit(held, asking, key_[0].as_py())
        lists_ = unit.asking.column("p").to_pylist()
        windows = [[(-((-low * x["positive_score"]) // 100), high * x["positive_score"] // 100) for x in p] for p in lists_]
        out: list[list] = [[] for _ in names]
        for a, (each, p) in enumerate(zip(negatives(unit, windows, n_negatives), lists_)):
            akey = unit.asking.column("akey")[a].as_py()
            for x, (ids, scores) in zip(p, each):
                for one, score in zip(ids.tolist(), scores.tolist()):
                    for column, v in zip(out, (unit.own[a].item(), akey, x["at"], x["positive_id"], x["positive_score"], one, score)):
                        column.append(v)
        release()
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(names.items(), out)})

    left, right = units(candidates, with_positives)
    hard = left.groupBy("dim", "block", "lot").cogroup(right.groupBy("dim", "block", "lot")).applyInArrow(second, f"anchor_id {kind}, akey long, at int, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long")
    order = Window.partitionBy("anchor_id", "akey", "at").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose id is divisible by 100; labels of ids divisible by 7 are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


OP11_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS y
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, list_inner_product(a.y, r.y)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.y) = len(r.y)
),
positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN (SELECT * FROM scored WHERE NOT same) USING (anchor_id)
WHERE {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}
"""
