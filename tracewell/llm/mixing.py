"""Mixing sources to target weights by Poisson replication.

Each source s has n_s rows and a target weight w_s; with M rows wanted in all its rate is w_s * M / n_s, the
mean number of copies of each of its rows. A row's count is the Poisson distribution of that mean inverted at
a uniform number hashed from seed and id: the number of k whose cumulative probability is not above it. A mean above
``MEAN`` is drawn as a sum of Poisson counts of equal smaller means, each from its own hash, as exp(-mean) is zero for
large ones and the table of probabilities would grow with the mean. Rows
are exploded by their counts, and the copies dealt out and sorted by a hash of seed, id and copy number, which
is a global shuffle. DataFrame functions only.

A null source is a source of its own (its name is the empty string for weights). A row with a null id draws
from the hash of the empty string. Repeated ids draw alike, as the draw depends on seed and id only. A source without a target
weight gets none of its rows; one with a weight but no rows takes nothing, its share is not given to others.
Input columns named as an added one (copy, shuffle_key) are replaced, others may have any name. Texts of any length are carried along. Equal shuffle keys (of
rows that repeat an id) stand in any order. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_table, table

#: Sources up to this many go to every executor as a table of rates; more are joined, with salted keys.
BROADCAST_SOURCES, SALTS = 10_000, 64
SEED = "mix-1"
#: The largest mean that is drawn at once.
MEAN = 500


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of seed and parts."""
    key = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def most_copies(rate: float) -> int:
    """A k that the Poisson distribution exceeds with a probability below 2**-52, so that no draw is cut."""
    return math.ceil(rate + 12 * math.sqrt(rate) + 24)


def cumulative(rate: Column) -> Column:
    """P(X <= k) of the Poisson distribution for k = 0, 1, ... up to where it is 1 for any draw."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def parted(rated: DataFrame) -> DataFrame:
    """rated with the number of Poisson counts that a row's draw is the sum of, and the probabilities of each."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("__mix_rate") / MEAN)).cast("int")
    return rated.withColumn("__mix_parts", parts).withColumn("__mix_cdf", cumulative(F.col("__mix_rate") / F.col("__mix_parts")))


def draws(seed: str, key: str) -> Column:
    """A uniform number for each of a row's parts; the first hashes seed and id alone."""
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.transform(F.sequence(F.lit(1), F.col("__mix_parts")), lambda i: uniform(seed, F.when(i == 1, own).otherwise(F.concat_ws(":", F.lit("part"), i.cast("string"), own))))


def rates(df: DataFrame, source: str, weights: dict[str, float] | None, power: float, total: int | None) -> DataFrame:
    """A row for each source: its rate of copies. Without weights, a source's weight is its size to a power."""
    sizes = df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("__mix_source")).agg(F.count("*").alias("_n"))
    if weights is not None:
        named = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))) if weights else F.create_map().cast("map<string,double>")
        sized = sizes.withColumn("_w", F.coalesce(F.element_at(named, F.col("__mix_source")), F.lit(0.0)))
        whole = F.lit(float(sum(weights.values()) or 1.0))
    else:
        sized = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)))
        whole = None
    sums = sized.agg(F.sum("_w").alias("_whole"), F.sum("_n").alias("_all"))
    rows = sized.join(F.broadcast(sums))  # one row
    wanted = F.lit(float(total)) if total is not None else F.col("_all").cast("double")
    return rows.select("__mix_source", (F.col("_w") / (whole if whole is not None else F.col("_whole")) * wanted / F.col("_n")).alias("__mix_rate"))


def poisson_mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None, seed: str = SEED) -> DataFrame:
    """df's rows, each as often as it was drawn, in a random order; adds copy (from 0) and shuffle_key."""
    spark = df.sparkSession
    df = df.drop("copy", "shuffle_key")
    found = rates(df, source, weights, power, total)
    few = small_table(found, BROADCAST_SOURCES)
    rated = df.withColumn("__mix_source", F.coalesce(F.col(source), F.lit("")))
    if few is not None:
        local = spark.createDataFrame([(r[0], r[1]) for r in few], "__mix_source string, __mix_rate double")
        rated = rated.join(F.broadcast(parted(local)), "__mix_source")
    else:
        salted = parted(found).withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rated.withColumn("__mix_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")).join(salted, ["__mix_source", "__mix_salt"])
    copies = F.aggregate(F.col("__mix_u"), F.lit(0), lambda n, u: n + F.size(F.filter(F.col("__mix_cdf"), lambda c: c <= u)))
    drawn = rated.withColumn("__mix_u", draws(seed, key)).withColumn("__mix_copies", copies).where("__mix_copies > 0")
    each = drawn.select(*(F.col(c) for c in df.columns), F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1)).alias("copy"))
    keyed = each.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string"))))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that a source's share goes with the square root of its size."""
    return poisson_mix(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
rated AS (SELECT s, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate FROM sizes),
parted AS (SELECT s, greatest(1, ceil(rate / {MEAN}))::INTEGER AS parts, rate / greatest(1, ceil(rate / {MEAN}))::INTEGER AS mean FROM rated),
steps AS (
  SELECT s, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM parted
  UNION ALL
  SELECT s, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps WHERE k + 1 <= ceil(mean + 12 * sqrt(mean) + 24)
),
cdfs AS (SELECT s, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY s),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda c: c <=
    ('0x' || substr(md5('{SEED}:' || CASE WHEN i = 1 THEN '' ELSE 'part:' || i || ':' END || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0))))::BIGINT AS n
  FROM documents d JOIN cdfs ON coalesce(d.source, '') = s JOIN parted USING (s)
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM drawn WHERE n > 0)
"""
