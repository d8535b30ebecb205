"""Decontamination of training texts by winnowing, with DataFrame functions alone.

Words are runs of letters a-z (A-Z are lower-cased), digits and all characters beyond ASCII. A benchmark item's windows are its runs of ``WINDOW``
words; an item of fewer words is one window. Of the ``WINDOW - GRAM + 1`` hashes of ``GRAM`` words in a window the least is kept: a text's fingerprints.
Whatever shares a window shares its least hash, so that every shared window is met, though only one place in four or so is compared.

1. Documents' fingerprints, each different one once a document, meet the benchmark's. What is written is a row for each document and one for each meeting.
2. Documents with a meeting are read again. Each meeting is extended to all windows that it is the least hash of, and those are compared with the benchmark's windows as
   strings: a hash only proposes.
3. Places that the windows found cover are counted, and their items gathered; windows that stand in the same items share one list of them.

Windows of items with fewer than WINDOW words have a hash of all their words, which needs no thinning; only lengths that the benchmark has are looked for.
The benchmark's fingerprints and windows are broadcast where their bytes are counted to be below ``BROADCAST``; beyond, they are joined by shuffles, which AQE splits where
a passage is in very many documents.

Null and empty texts and texts without words have no words and no hit. Rows alike in id and text are rows each. A null id is an id. Items that repeat an id are one item with the windows of
both; items with a null id or no words have no part. An empty table gives an empty result, an empty benchmark no hit. Extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW, GRAM = 10, 4
#: Bytes of fingerprints or windows, as counted, that go to every executor.
BROADCAST = 64 << 20
UPPER = "".join(map(chr, range(65, 91)))
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """A text's words; null has none."""
    spaced = F.translate(text, UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.array_remove(F.split(F.coalesce(spaced, F.lit("")), " "), "")


def beside(values: Column, by: int, join) -> Column:
    """join of each value and the one `by` places later, as far as there is one."""
    left = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, 1, left), F.slice(values, by + 1, left), join)


def grown(df: DataFrame, column: str, size: int, join) -> DataFrame:
    """df with column's values joined over `size` neighbours, by doubling; the last step's two halves may overlap."""
    wide = 1
    while wide < size:
        by = min(wide, size - wide)
        df = df.withColumn(column, beside(F.col(column), by, join(wide)))
        wide += by
    return df


def hashed(df: DataFrame, name: str, size: int) -> DataFrame:
    """df with the least hash of each window of `size` words of the hashes in _h, as column name."""
    gram = GRAM if size == WINDOW else size
    df = grown(df.withColumn(name, F.col("_h")), name, gram, lambda wide: lambda a, b: F.shiftleft(a, 2 * wide + 1).bitwiseXOR(F.shiftrightunsigned(a, 63 - 2 * wide)).bitwiseXOR(b))
    return grown(df, name, size - gram + 1, lambda wide: lambda a, b: F.least(a, b))


def with_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df with _m<size> for each size: entry i is the least hash of the window of words that starts at word i."""
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    for size in sizes:
        df = hashed(df, f"_m{size}", size)
    return df.drop("_h")


def windows_of(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(size, window, m, items): the benchmark's different windows, their least hashes, and the items that have each."""
    items = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    items = items.withColumn("size", F.least(F.size("_w"), F.lit(WINDOW)))
    starts = F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("size") + 1))
    each = items.select("item", "size", "_w", starts.alias("at")).select("item", "size", F.array_join(F.slice("_w", F.col("at"), F.col("size")), " ").alias("window"))
    grouped = each.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return written(grouped.withColumn("_w", F.split("window", " ")))


def met_places(size: int) -> Column:
    """The windows of that size whose least hash is one of the hits."""
    every = F.transform(f"_m{size}", lambda m, i: F.when(F.array_contains("hits", m), F.struct((i + 1).alias("at"), F.lit(size).alias("size"))))
    return F.filter(every, lambda p: p.isNotNull())


def maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST else df


def contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, n_words, n_hit, items): each row of docs, and the benchmark items that it has windows of, sorted as strings."""
    wanted = windows_of(benchmark, item, item_text)
    # Of the benchmark: its windows' lengths (ten at most), and the bytes of fingerprints and windows.
    found = wanted.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + 16 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)).alias("bytes")).collect()
    sizes, count, size = sorted(r["size"] for r in found) or [WINDOW], sum(r["n"] for r in found), sum(r["bytes"] for r in found)
    prints = with_hashes(wanted, sizes).select(F.explode(F.concat(*(F.when(F.col("size") == s, F.col(f"_m{s}")).otherwise(F.array().cast("array<bigint>")) for s in sizes))).alias("h")).distinct().withColumn("met", F.lit(True))

    # Two hashes, with either first, name a row's id and text; they need not be of different rows, as rows alike have one result.
    own = [F.xxhash64(F.lit(1), F.col(doc), F.col(text)).alias("_a"), F.xxhash64(F.lit(2), F.col(text), F.col(doc)).alias("_b")]
    read = with_hashes(docs.select(F.col(doc).alias("_id"), *own, words(F.col(text)).alias("_w")), sizes)
    marks = F.array_distinct(F.concat(*(F.col(f"_m{s}") for s in sizes)) if len(sizes) > 1 else F.col(f"_m{sizes[0]}"))
    each = read.select("_id", "_a", "_b", F.size("_w").cast("long").alias("n_words"), F.posexplode_outer(marks).alias("_at", "h"))
    met = each.join(maybe_broadcast(prints, 16 * count), "h", "left").where(F.col("met") | F.coalesce(F.col("_at"), F.lit(0)).eqNullSafe(0))
    met = written(met.select("_id", "_a", "_b", "n_words", F.coalesce("_at", F.lit(0)).alias("_at"), F.when(F.col("met"), F.col("h")).alias("h")))
    base = met.where("_at = 0").select("_id", "_a", "_b", "n_words")
    hits = met.where("h is not null").groupBy("_a", "_b").agg(F.collect_set("h").alias("hits"))

    again = docs.select(*own, F.col(text).alias("_text")).join(hits, ["_a", "_b"]).select("_a", "_b", "hits", words(F.col("_text")).alias("_w"))
    again = with_hashes(again, sizes)
    places = F.concat(*(met_places(s) for s in sizes))
    extended = again.select("_a", "_b", "_w", places.alias("_p")).select("_a", "_b", F.explode(F.transform("_p", lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), F.array_join(F.slice("_w", p["at"], p["size"]), " ").alias("window")))).alias("_p"))
    same = extended.select("_a", "_b", "_p.*").join(maybe_broadcast(wanted.select("size", "window", "items"), size), ["size", "window"])
    spans = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "size"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(F.greatest(a["end"], p["at"] + p["size"]).alias("end"), (a["n"] + F.greatest(p["at"] + p["size"] - F.greatest(a["end"], p["at"]), F.lit(0))).alias("n")),
    )["n"]
    result = same.groupBy("_a", "_b").agg(spans.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = base.join(result, ["_a", "_b"], "left")
    return out.select(F.col("_id").alias(doc), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the benchmark items that they share windows with."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT size FROM wanted),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, lengths WHERE len(w) >= size),
found AS (SELECT p.r, p.i, p.size, x.item FROM (SELECT r, i, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win FROM places) p JOIN wanted x USING (size, win)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
