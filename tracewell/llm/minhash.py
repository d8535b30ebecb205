"""Near-duplicate documents by SuperMinHash.

A text's set is its distinct word shingles, as 64-bit hashes. SuperMinHash gives each shingle a random
permutation of the signature's slots: in step j it offers its j-th slot the value j plus a random fraction, and a slot
keeps its least offer. All shingles take step j together, and a text stops as soon as no slot can still be
lowered (its largest value is below j), which for long texts is after two or three steps. Bands of the signature, each
hashed, give candidates: sets that share a band. Links are confirmed on full sets, and give the
components by union-find in each task first and by hooking and pointer jumping over the cluster after that.

* Connected pieces of "shares a band" with up to ``LARGE`` sets are compared whole, so that a set travels once: in units of pieces, or of
  two blocks of one piece, bounded by their sets and their bytes.
* In a larger piece (templated text chains into such) each set is first compared with the least set of its most crowded band only, which is linear and
  brings copies together. After that, a band needs a comparison only across the components that meet in it: the sets outside of the
  band's main component among themselves and with those inside, in pairs of blocks.

Texts with equal sets are one representative throughout, so that copies, however many, are never compared or expanded. No candidate
is dropped: 24 bands of 5 slots miss a pair at similarity 0.85 with a probability below 1e-6, 40 bands one at 0.8 with one below 2e-7.

Null and empty texts have empty sets and are linked with nothing. Fewer words than a shingle's form one
shingle. Very long texts are hashed whole, one at a time. Rows that repeat an id are one document each but share the component of that id: each of its sets is compared,
under the hash of a text that has it, and all of them are united. Rows with a null id
are kept, with themselves as component (null). Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, chunks, mix, prefix_hash, small_batches, span_hash, table, text_bytes, union_find, word_spans, written

WORDS, PERCENT = 5, 85
BANDS, ROWS = 24, 5
#: A piece is cut into about BLOCKS blocks, of LEAST_BLOCK members at least and of MOST_BLOCK members and BLOCK_BYTES of sets at most.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 16, 64, 4096, 4 << 20
#: Pieces with more sets are compared by bands; sets that are compared with one leader in a task.
LARGE, FOLLOWERS = 16_384, 1024
#: A set is hot if more than one in SHARE of all texts has it, and at least so many.
SHARE, LEAST_COPIES = 1000, 100


# ---- sets and signatures ----------------------------------------------------------------------------------------


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows and their rows, in order of row and hash."""
    buf = LOWER[buf]
    start, end, row = word_spans(buf, offsets)
    word = span_hash(prefix_hash(buf), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    size = np.diff(first)
    place = np.arange(len(row)) - first[row]
    lead = np.flatnonzero((place + words <= size[row]) | ((place == 0) & (size[row] < words)))
    h = np.zeros(len(lead), np.uint64)
    for i in range(words):
        at = lead + i
        inside = (place[lead] + i < size[row[lead]]) if len(lead) else np.zeros(0, bool)
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word[np.minimum(at, len(word) - 1)], np.uint64(i)))
    of = row[lead]
    by = np.lexsort((h, of))
    h, of = h[by], of[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], of[new]


def super_minhash(h: np.ndarray, row: np.ndarray, rows: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (rows x slots): step in the upper, random fraction in the lower 32 bits of each value."""
    full = np.uint64(2**64 - 1)
    out = np.full(rows * slots, full)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        if not len(h):
            break
        r = mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = np.uint64(j) + (((r >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32))
        k = k.astype(np.int32)
        # What a Fisher-Yates shuffle has brought to place k: step i left there what stood in place i before it.
        slot = k.copy()
        for i in range(j - 1, -1, -1):
            slot[swaps[i] == slot] = i
        swaps.append(k)
        np.minimum.at(out, row * slots + slot, (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
        # Early stopping: the next step offers j + 1 at least.
        largest = out.reshape(rows, slots).max(1)
        on = (largest >= (np.uint64(j + 1) << np.uint64(32)))[row]
        if not on.all():
            h, row, swaps = h[on], row[on], [s[on] for s in swaps]
    return out.reshape(rows, slots)


def sketches(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, fp, bands, said): each text's set size, a 128-bit fingerprint of its set, its bands' hashes, and its own hash."""

    def run(batches):
        for b in chunks(batches, "_text"):
            buf, offsets = text_bytes(b.column(2))
            h, row = shingles(buf, offsets, words)
            n = np.bincount(row, minlength=b.num_rows)
            sums = []
            for salt in (0x1234567, 0x89ABCDE):
                total = np.r_[np.uint64(0), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)]
                ends = np.cumsum(n)
                sums.append((total[ends] - total[ends - n]).astype(np.int64))
            sig = super_minhash(h, row, b.num_rows, bands * rows).reshape(b.num_rows, bands, rows)
            band = np.zeros((b.num_rows, bands), np.uint64)
            for i in range(rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            band = mix(band + np.arange(bands, dtype=np.uint64)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists, b.column(1)], names=["id", "n_shingles", "fp1", "fp2", "bands", "said"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("fp1", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("said", T.LongType())])
    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("said"), F.col(text).alias("_text")).mapInArrow(run, schema)


# ---- components -------------------------------------------------------------------------------------------------


def _local_forest(batches):
    """Of each batch of edges, those from every node to its smallest: the same components from fewer edges."""
    for b in batches:
        if b.num_rows:
            a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            nodes, at = np.unique(np.r_[a, c], return_inverse=True)
            root = union_find(at[: len(a)], at[len(a) :], len(nodes))
            own = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each node of edges (a, b: long) the smallest node that it reaches.

    Each round, every node takes the least label around it, a label's nodes hand the least of theirs to the label itself, and labels
    follow labels. Rounds go with the logarithm of the longest path; each is cut off as a written table.
    """
    # A few columns of numbers: one batch of a task is reduced before anything is shuffled.
    edges = written(edges.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct())
    both = edges.union(edges.select("b", "a"))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_other").alias("_near"))
        offered = labels.join(near, "id").select("id", "component", F.least("component", "_near").alias("_new"))
        hooks = offered.groupBy("component").agg(F.min("_new").alias("_hook"))  # label -> the least label beside it
        hooked = offered.join(hooks, "component").select("id", "component", F.least("_new", "_hook").alias("_new"))
        up = labels.select(F.col("id").alias("_new"), F.col("component").alias("_up"))
        after = written(hooked.join(up, "_new").select("id", F.least("_new", "_up").alias("component"), (F.least("_new", "_up") < F.col("component")).alias("moved")))
        labels = after.select("id", "component")
        if not after.where("moved").limit(1).count():
            return labels


# ---- confirmed links --------------------------------------------------------------------------------------------


def confirmed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between the sets numbered a and the sets numbered b: intersections as a product of 0/1 matrices."""
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), size)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], number[column[keep]]
    both = np.zeros((len(a), len(b)), np.float32)
    by = np.argsort(column, kind="stable")
    of, column = of[by], column[by]
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    wide = max(256, 2_000_000 // max(1, len(a) + len(b)))
    for low in range(0, int(shared.sum()), wide):
        i, j = np.searchsorted(column, (low, low + wide))
        x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        for m, place in ((x, place_a), (y, place_b)):
            mine = place[of[i:j]]
            m[mine[mine >= 0], column[i:j][mine >= 0] - low] = 1
        both += x @ y.T
    union = size[a][:, None] + size[b][None, :] - both
    return np.nonzero(100 * both >= percent * union)


def unit_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The links of one unit: several whole pieces, or two sides of one piece (0 and 1; -1 is on both). Only a forest of them is returned."""
    out = []
    for _, piece in pdf.groupby("piece", sort=False):
        if len(piece) < 2:
            continue
        ids = piece["id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in piece["shingles"]]
        side = piece["side"].to_numpy()
        a = np.flatnonzero(side <= 0)
        b = np.flatnonzero(side != 0)
        if not len(a) or not len(b):
            continue
        i, j = confirmed(sets, a, b, percent)
        i, j = a[i], b[j]
        off = i != j
        root = union_find(i[off], j[off], len(ids))
        own = np.flatnonzero(root != np.arange(len(ids)))
        out.append(pd.DataFrame({"a": ids[own], "b": ids[root[own]]}))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def shingle_sets(members: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """members (id, said, ...) with shingles: the set of the text of that id and hash.

    Both sides are dealt by id at every size, so that a plan over a small table is that of a large one."""
    keep = [f for f in members.schema.fields if f.name not in ("id", "said")]

    def run(batches):
        for b in chunks(batches, "_text"):
            h, row = shingles(*text_bytes(b.column(2)), words)
            ends = np.cumsum(np.bincount(row, minlength=b.num_rows))
            got = pa.array([x.tobytes() for x in np.split(h, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[3:], got], names=["id", "said", *(f.name for f in keep), "shingles"])

    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("said"), F.col(text).alias("_text"))
    wanted = texts.join(members.hint("shuffle_hash"), ["id", "said"]).dropDuplicates(["id", "said"])
    schema = T.StructType([members.schema["id"], members.schema["said"], *keep, T.StructField("shingles", T.BinaryType())])
    return wanted.select("id", "said", "_text", *(f.name for f in keep)).mapInArrow(run, schema)


def piece_links(members: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(a, b): a forest of the confirmed links inside the pieces of members (id, said, n, component, size, total)."""
    width = F.least(F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("size") / BLOCKS)), F.lit(MOST_BLOCK))
    blocks = F.greatest(F.ceil(F.col("size") / width), F.ceil(8 * F.col("total") / BLOCK_BYTES)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "said"), F.col("blocks")).cast("int"))
    bytes_ = 8 * (members.agg(F.sum("n")).first()[0] or 0)
    sets = shingle_sets(placed.select("id", "said", "component", "block", "blocks"), docs, key, text, words)
    # A unit of blocks (i, j), i <= j: a member of block x takes part in (x, j) as side 0 and in (i, x) as side 1; within (x, x) it is both (-1).
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("other") == F.col("block"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    whole = F.col("blocks") == 1
    # Whole pieces go by lots of about a block's bytes, however many there are.
    unit = F.when(whole, F.pmod(F.xxhash64("component"), F.lit(2 * bytes_ // BLOCK_BYTES + 12))).otherwise(-1 - F.pmod(F.xxhash64("component", low, high), F.lit(1 << 62)))
    units = paired.select("id", F.when(whole, F.col("component")).otherwise(unit).alias("piece"), side.alias("side"), unit.alias("unit"), "shingles")
    return units.groupBy("unit").applyInPandas(lambda pdf: unit_links(pdf, percent), "a long, b long")


def blocks_of(sets, size):
    """How many blocks keep to FOLLOWERS sets and BLOCK_BYTES bytes."""
    return F.greatest(F.ceil(sets / FOLLOWERS), F.ceil(size / BLOCK_BYTES)).cast("int")


def band_links(members: DataFrame, shared: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(a, b): the confirmed links among members (id, said, n) that share a band (shared: band, id, said, head, n), where they may be many."""
    sets = written(shingle_sets(members.select("id", "said"), docs, key, text, words))
    node = ["id", "said"]
    mine = shared.join(members.select(*node, (8 * F.col("n")).alias("bytes")), node)
    # First each set with the least one of its most crowded band, in parts with that leader on side 0.
    first = mine.groupBy(*node).agg(F.max(F.struct("n", "band", "head")).alias("_most"), F.first("bytes").alias("bytes")).select(*node, F.col("_most.head.id").alias("lead"), F.col("_most.head.said").alias("lead_said"), "bytes")
    led_by = first.groupBy("lead", "lead_said").agg(blocks_of(F.count("*"), F.sum("bytes")).alias("parts"))
    first = written(first.join(led_by, ["lead", "lead_said"]).withColumn("part", F.pmod(F.xxhash64(*node), F.col("parts")).cast("int")))
    group = F.xxhash64("lead", "lead_said", "part")
    led = first.join(sets, node).select("id", group.alias("unit"), F.lit(1).alias("side"), "shingles")
    leaders = first.select("lead", "lead_said", "part").distinct().join(sets.select(F.col("id").alias("lead"), F.col("said").alias("lead_said"), "shingles"), ["lead", "lead_said"])
    units = led.unionByName(leaders.select(F.col("lead").alias("id"), group.alias("unit"), F.lit(0).alias("side"), "shingles")).withColumn("piece", F.col("unit"))
    near = written(units.groupBy("unit").applyInPandas(lambda pdf: unit_links(pdf, percent), "a long, b long"))
    # Then what meets in a band across components.
    now = mine.select("band", *node, "bytes").join(components(near), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = now.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max(F.struct("n", "component", "bytes"))
    bands = parts.groupBy("band").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("components")).where("components > 1")
    ins, outs = blocks_of(F.col("main.n"), F.col("main.bytes")), blocks_of(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    bands = bands.select("band", F.col("main.component").alias("main"), ins.alias("ins"), outs.alias("outs"))
    open_ = now.drop("bytes").join(bands, "band").withColumn("_in", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64(*node), F.when(F.col("_in"), F.col("ins")).otherwise(F.col("outs"))).cast("int")
    open_ = open_.withColumn("block", block)
    # Blocks are numbered: those outside of the main component, then those inside. A set meets all blocks outside; one outside, all blocks.
    at = F.when(F.col("_in"), F.col("outs") + F.col("block")).otherwise(F.col("block"))
    upto = F.when(F.col("_in"), F.col("outs")).otherwise(F.col("outs") + F.col("ins"))
    paired = open_.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    side = F.when(F.col("at") == F.col("other"), -1).when(F.col("at") < F.col("other"), 0).otherwise(1)
    unit = F.xxhash64("band", F.least("at", "other"), F.greatest("at", "other"))
    rest = paired.select(*node, unit.alias("unit"), side.alias("side")).join(sets, node).withColumn("piece", F.col("unit")).drop("said")
    return near.unionByName(rest.groupBy("unit").applyInPandas(lambda pdf: unit_links(pdf, percent), "a long, b long"))


def same_ids(real: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): of each id with several sets, the links from it to those of its sets that go by a smaller id."""
    pair = F.struct("fp1", "fp2")
    several = real.groupBy("id").agg(F.min(pair).alias("_least"), F.max(pair).alias("_most")).where("_least <> _most").select("id")
    sets = real.select("id", "fp1", "fp2").join(several, "id", "left_semi").distinct()
    return sets.join(reps.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: n_shingles, component_id (the smallest id reachable over links) and kept (whether that is its own)."""
    small_batches(docs.sparkSession)
    sketched = written(sketches(docs, key, text, words, bands, rows))
    real = sketched.where("n_shingles > 0 and id is not null")
    reps = real.groupBy("fp1", "fp2").agg(F.min(F.struct("id", "said")).alias("_first"), F.min_by("bands", "id").alias("bands"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    reps = written(reps.select("fp1", "fp2", F.col("_first.id").alias("rep"), F.col("_first.said").alias("said"), "bands", "copies", "n"))
    banded = reps.select(F.col("rep").alias("id"), "said", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min(F.struct("id", "said")).alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = banded.join(heads, "band")
    stars = shared.select(F.col("id").alias("a"), F.col("head.id").alias("b")).where("a <> b").distinct()
    # Sets that go by one id are one node, as they share its component, but a member of the piece each.
    pieces = components(stars)
    placed = written(reps.select(F.col("rep").alias("id"), "said", "n").join(pieces, "id"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    members = written(placed.join(sizes, "component"))
    docs = docs.where(F.col(key).isNotNull())
    confirmed_links = piece_links(members.where(F.col("size") <= LARGE), docs, key, text, words, percent)
    large = members.where(F.col("size") > LARGE)
    if large.limit(1).count():
        confirmed_links = confirmed_links.unionByName(band_links(large, shared, docs, key, text, words, percent))
    linked = components(confirmed_links.union(same_ids(real, reps)))
    owners = reps.select("fp1", "fp2", "rep", "copies").join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", "copies", F.coalesce("component", "rep").alias("component_id"))
    # Sets with so many copies are fewer than SHARE, whatever the input, so they go to every task and no key of the join is hot.
    many = max(real.count() // SHARE, LEAST_COPIES)
    hot, rest = owners.where(F.col("copies") > many).drop("copies"), owners.where(F.col("copies") <= many).drop("copies")
    own = sketched.select("id", "n_shingles", "fp1", "fp2")
    linkable = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    keyed = own.where(linkable)
    common = keyed.join(F.broadcast(hot), ["fp1", "fp2"])
    others = keyed.join(F.broadcast(hot.select("fp1", "fp2")), ["fp1", "fp2"], "left_anti").join(rest, ["fp1", "fp2"])
    alone = own.where(~linkable).withColumn("component_id", F.col("id"))
    joined = common.unionByName(others).unionByName(alone)
    return joined.select(F.col("id").alias(key), "n_shingles", "component_id").withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
