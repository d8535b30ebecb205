"""Quality by perplexity: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are bytes, all 256 of them, so that no letter of any script is folded into another; an n-gram is ``ORDER`` bytes (a text begins
after line ends). The model grows with the corpus:

1. The n-grams of all trusted texts (quality label 1) are counted, partly in each task and then in shards; the counts are stored once. Continuation
   counts and discounts of the lower orders come from them.
2. The n-grams of all texts are gathered in the same way, and every order's probability of each is worked out by joins with the counts of
   n-grams and of contexts, from order 1 up.
3. Documents go in blocks. A block asks the shards for its different n-grams only, packed; the shards answer, and the block adds up the
   code length of each text. Texts travel once, compressed; nothing of the model is broadcast.

A text is rejected above its language's threshold: an exact high quantile of the trusted texts of that language, times a margin. A language with fewer than
``LEAST_TRUSTED`` trusted texts takes the threshold of all. Trusted texts are found by a join on the id; a bit map of fixed size keeps most
others out of it.

A null or empty text, or one of white space only, has no perplexity (null) and is rejected. Very long texts count whole and are worked on in slices.
Repeated rows get the same verdict each; a text exactly at the threshold is kept. Without trusted texts every text with a word is kept. Rows with a null id are
judged, but never trusted. Input columns named as an added one are replaced, others may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asking import BLOCK, SHARD, Tally, answered, asked, grams, mask, packed_table, packed_texts, shard_of, unpacked
from .common import SPACE, chunks, release, small_batches, small_table, table, text_bytes, written

ORDER = 5
LEAST_TRUSTED = 50
QUANTILE, MARGIN = 0.99, 1.1
#: Parts of a doubling of the perplexity that values are counted in before a quantile is looked up.
STEPS = 1024
#: Languages up to this many go to every task with their thresholds; more are joined, with salted keys.
LANGUAGES, SALTS = 10_000, 64
#: Bits of the map of trusted ids.
MAP = 1 << 26


# ---- n-grams ----------------------------------------------------------------------------------------------------


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(g, c): how often each n-gram occurs in all texts, counted partly in each task. A binary text is a compressed one."""
    packed = isinstance(docs.schema[text].dataType, T.BinaryType)

    def run(batches):
        tally = Tally()
        for b in unpacked(batches, "_text") if packed else chunks(batches, "_text"):
            yield from tally.add(grams(*text_bytes(b.column(0)), ORDER)[0])
        yield from tally.rest()
        release()

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, p): for each n-gram asked for, the probability of its last byte after the others.

    The highest order has the counts (g, c), a lower one the number of different bytes seen before its n-gram. Each
    order has three discounts, for counts of one, two, and more, from its counts of counts."""
    low = F.lit(1 / 256)
    lower = None
    for k in range(1, ORDER + 1):
        seen = counts if k == ORDER else counts.select(F.col("g").bitwiseAND(mask(k + 1)).alias("g")).distinct().groupBy(F.col("g").bitwiseAND(mask(k)).alias("g")).agg(F.count("*").alias("c"))
        n = [float(x or 0) for x in seen.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5, 0.1), i - 0.1) for i in (1, 2, 3)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("g", 8)
        after = seen.groupBy(context.alias("h")).agg(F.sum("c").cast("double").alias("t"), F.sum(cut).alias("freed"))
        own = seen.select("g", (F.col("c") - cut).alias("own"))
        every = asked if k == ORDER else asked.select(F.col("g").bitwiseAND(mask(k)).alias("g")).distinct()
        every = every.withColumn("h", context).join(own, "g", "left").join(after, "h", "left")
        if lower is not None:
            every = every.withColumn("low", F.col("g").bitwiseAND(mask(k - 1))).join(lower.withColumnRenamed("g", "low"), "low")
            low = F.col("p")
        p = F.when(F.col("t").isNull(), low).otherwise((F.coalesce("own", F.lit(0.0)) + F.col("freed") * low) / F.col("t"))
        lower = written(every.select("g", p.alias("p")))
    return lower


# ---- trusted texts ----------------------------------------------------------------------------------------------


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of all trusted rows."""
    return labels.where("quality = 1").where(F.col(key).isNotNull()).select(key).distinct()


def trusted(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with trusted ids: both sides dealt by id, a task's ids held as a hash table, so that texts are not sorted."""
    return rows.where(F.col(key).isNotNull()).join(trusted_ids(labels, key).hint("shuffle_hash"), key, "left_semi")


def id_map(ids: DataFrame, key: str) -> np.ndarray:
    """MAP bits, set where the hash of an id falls: MAP / 64 rows at most."""
    place = F.pmod(F.xxhash64(key), F.lit(MAP))
    rows = ids.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")).alias("b")).toArrow()
    out = np.zeros(MAP // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint64)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(g, c) of all trusted texts, stored."""
    likely = docs.where(F.col(key).isNotNull()).select(key, text, F.pmod(F.xxhash64(key), F.lit(MAP)).alias("_place"))
    likely = packed_texts(likely, text, id_map(trusted_ids(labels, key), key), "_place")
    return written(count_grams(trusted(likely, labels, key), text))


# ---- perplexity -------------------------------------------------------------------------------------------------


def with_perplexity(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to carry (the text may be one of them), with n_symbols and perplexity (per byte; null for blank texts)."""
    blocks = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BLOCK + 1
    whole = text in carry
    fields = [T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate(carry) if c != text]
    ready = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(carry) if c != text), F.col(text).alias("_text"), F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("_block"))

    def codes_of(batch: pa.RecordBatch):
        """A batch's n-grams; the texts, their sizes, what of them is no space, and the n-grams' rows."""
        buf, offsets = text_bytes(batch.column(0))
        code, row = grams(buf, offsets, ORDER)
        return code, (batch.column(0) if whole else None, np.diff(offsets), np.bincount(row, ~SPACE[buf], batch.num_rows), row.astype(np.int32))

    def add(group: pa.Table, parts) -> pa.Table:
        n, bits, words, texts = [], [], [], []
        for (text_, size, dark, row), values in parts:
            n.append(size)
            bits.append(np.bincount(row, values, len(size)))
            words.append(dark)
            texts.append(text_)
        n, bits, words = (np.concatenate(x or [np.zeros(0)]) for x in (n, bits, words))
        out = {f.name: group.column(f.name) for f in fields} | ({"_text": pa.chunked_array(texts, pa.string())} if whole else {})
        return pa.table(out | {"n_symbols": pa.array(n.astype(np.int64)), "perplexity": pa.array(np.exp2(bits / np.maximum(n, 1)), mask=words == 0)})

    schema = T.StructType([*fields, *([T.StructField("_text", docs.schema[text].dataType)] if whole else []), T.StructField("n_symbols", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    placed, shards = packed_texts(ready, "_text"), model.count() // SHARD + 12
    held = packed_table(model.select("g", (-F.log2("p")).alias("v")), shards, shard_of)
    found = answered(placed, "_text", shards, held, asked(placed, "_text", shards, codes_of), codes_of, add, schema, number=np.float64)
    return found.select(*(F.col("_text" if c == text else f"_{i}").alias(c) for i, c in enumerate(carry)), "n_symbols", "perplexity")


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """(of, n, at): of each group of values (of, v: positive), their number and exact quantile, between neighbours as F.percentile.

    Values are counted in steps of their logarithm first, which are few; only the steps that hold the quantile are looked
    into, so that no task gathers a group's values.
    """
    values = values.where("v is not null").withColumn("step", F.floor(F.log2("v") * STEPS))
    place = (F.col("n") - 1) * F.lit(quantile)
    running = F.sum("c").over(Window.partitionBy("of").orderBy("step"))
    steps = values.groupBy("of", "step").agg(F.count("*").alias("c")).withColumn("upto", running).withColumn("n", F.sum("c").over(Window.partitionBy("of")))
    held = steps.withColumn("place", place).where(F.col("upto") - F.col("c") <= F.ceil("place")).where(F.col("upto") > F.floor("place"))
    inside = values.join(F.broadcast(held.select("of", "step", "n", "place", (F.col("upto") - F.col("c")).alias("before"))), ["of", "step"])  # two steps a group at most
    each = inside.groupBy("of", "step", "n", "place", "before", "v").agg(F.count("*").alias("c"))
    each = each.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("of", "step").orderBy("v")))
    ends = each.groupBy("of", "n", "place").agg(*(F.min(F.when(F.col("upto") > end("place"), F.col("v"))).alias(name) for name, end in (("low", F.floor), ("high", F.ceil))))
    part = F.col("place") - F.floor("place")
    return ends.select("of", "n", ((1 - part) * F.col("low") + part * F.col("high")).alias("at"))


def thresholds(scored_trusted: DataFrame, lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> tuple[DataFrame, float]:
    """(_lang, threshold): the largest perplexity that each language lets pass; and that of all languages."""
    of = F.explode(F.array(F.concat(F.lit("="), F.coalesce(F.col(lang), F.lit(""))), F.lit("all"))).alias("of")
    found = written(quantiles(scored_trusted.select(of, F.col("perplexity").alias("v")), quantile).withColumn("most", F.lit(margin) * F.col("at")))
    by = found.where(F.col("of").startswith("=") & (F.col("n") >= LEAST_TRUSTED))
    whole = found.where("of = 'all'").first()
    return by.select(F.expr("substr(of, 2)").alias("_lang"), F.col("most").alias("threshold")), float("inf") if whole is None else whole["most"]


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its columns that are named) with n_symbols, perplexity, threshold and kept."""
    small_batches(docs.sparkSession)
    added = ("n_symbols", "perplexity", "threshold", "kept")
    columns = tuple(c for c in (columns or docs.columns) if c not in added)
    asked = written(count_grams(docs, text).select("g"))
    model = kneser_ney(train(docs, labels, key, text), asked)
    scored = written(with_perplexity(docs, model, key, text, tuple(dict.fromkeys((*columns, key, lang)))))
    by, whole = thresholds(trusted(scored.select(key, lang, "perplexity"), labels, key), lang)
    ready = scored.withColumn("_lang", F.coalesce(F.col(lang), F.lit("")))
    if small_table(by, LANGUAGES) is not None:
        joined = ready.join(F.broadcast(by), "_lang", "left")
    else:
        salted = by.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = ready.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["_lang", "_salt"], "left")
    most = F.coalesce("threshold", F.lit(whole))
    kept = F.coalesce(F.col("perplexity") <= most, F.lit(False))
    return joined.select(*columns, "n_symbols", "perplexity", most.alias("threshold"), kept.alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=("doc_id", "lang"))
