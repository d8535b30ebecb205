"""Prediction by partial matching over a corpus, with a trie of byte contexts that grows with it.

A text is the sequence of its tokens: white-space words with A-Z lower-cased, a space between two, and one line end after
the last, which is its end. Its bytes are predicted one by one from the ``ORDER`` bytes before them, through the whole text and across tokens (a text
starts after line ends). The trie is learnt from all training texts, with no limit on its nodes:

* the longest context counts its symbols; a shorter one counts the different longer ones that it ends (update exclusion);
* escapes are estimated by a discount: each different symbol of a context hands ``DISCOUNT`` of a count to the escape;
* with symbol exclusion: a symbol that a context has met ``OFTEN`` times takes no probability in the shorter ones below it, whose rest is scaled up to one. A symbol
  met less often has both its own share and what the shorter contexts give it, so that orders are mixed where a context knows little. At sf0.01 this takes 13.72 bits a held-out token, against
  14.11 with all met symbols excluded and a discount of a quarter, in contexts of five bytes.

A text's score is the sum of its symbols' log10 probabilities under the trie as learnt (a pretrained code length). The probability of
a symbol depends on its n-gram of ORDER + 1 bytes only. Texts are dealt to blocks; a block asks shards for the different n-grams that it holds and says how often its training texts have each, so that one pass counts and asks.
A shard has all n-grams whose context ends with the same two bytes, hence all that orders two and up need; a table of 256 * 256 probabilities has the orders below. So a shard works
out its own probabilities, order by order, in arrays. Tokens go the same way, under 62-bit hashes, for the base score.

Null and empty texts are one end token. Repeated rows stay apart: each is scored as if alone. Very long texts are scored whole, in memory as a whole. An empty training set
leaves every token unknown: counts are 0 and every byte has the uniform rate. A row with a null id is in fold 0, hence a training text (its crc32 is
null). Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asking import BLOCK, ODD, answered, asked, grams, mask, merged, packed_texts, shard_of, unpacked_table
from .common import LOWER, crc_mod5, free_shuffles, gathered, prefix_hash, small_batches, span_hash, table, text_bytes, word_spans, written

#: Bytes of context; a symbol and its context are a code of 56 bits.
ORDER = 6
#: The part of a count that each different symbol of a context hands to the escape; how often a symbol is met before shorter contexts exclude it.
DISCOUNT, OFTEN = 0.75, 6
SPACE, END = 32, 10
#: Bytes of text for each shard of n-grams and words.
SHARD_BYTES = 32 << 20


def sequence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows' token sequences and their offsets; the words' codes (below 0) and rows."""
    buf = np.r_[LOWER[buf], np.uint8(0)]
    start, end, row = word_spans(buf[:-1], offsets)
    word = -(span_hash(prefix_hash(buf), start, end) >> np.uint64(2)).astype(np.int64) - 1
    rows = len(offsets) - 1
    none = np.setdiff1d(np.arange(rows), row)
    of = np.r_[row, none]
    by = np.argsort(of, kind="stable")
    of, begin, size = of[by], np.r_[start, np.zeros(len(none), np.int64)][by], np.r_[end - start + 1, np.ones(len(none), np.int64)][by]
    out, ends = gathered(buf, begin, size), np.cumsum(size)
    out[ends - 1] = SPACE
    out[ends[np.r_[of[1:] != of[:-1], True]] - 1 if len(of) else ends] = END
    return out, np.r_[0, np.cumsum(np.bincount(of, size, rows).astype(np.int64))], word, row


def mixed(n: np.ndarray, low: np.ndarray, total: np.ndarray, kinds: np.ndarray, excluded: np.ndarray) -> np.ndarray:
    """The probability of symbols met n times in contexts of total counts, kinds different symbols, and the share of excluded ones in the order below, where each has low."""
    escape = DISCOUNT * kinds / np.maximum(total, 1)
    below = np.where(n >= OFTEN, 0, escape * low / np.maximum(1 - excluded, 1e-9))
    return np.where(total == 0, low, np.where(n > 0, n - DISCOUNT, 0) / np.maximum(total, 1) + below)


def turned(code: np.ndarray) -> np.ndarray:
    """Codes of n-grams with their contexts' bytes from last to first, or back again: sorted codes of a shard, whose contexts end alike, then begin alike and take less room."""
    context = (code >> 8).byteswap().view(np.uint64) >> np.uint64(8 * (7 - ORDER))
    return context.view(np.int64) | (code & 255)


def short_orders(found: DataFrame) -> np.ndarray:
    """p[x, s]: the probability of s after x from orders one and none, by the different n-grams of three bytes that training texts have."""
    byte = lambda n: F.shiftright("g", 8 * n).bitwiseAND(255)
    last = byte(ORDER - 1) * 65536 + byte(ORDER) * 256 + byte(0)  # of a turned code
    pairs = found.where("g >= 0 and v > 0").select(last.alias("g")).distinct().groupBy(F.col("g").bitwiseAND(mask(2)).alias("g")).agg(F.count("*").alias("n")).collect()  # 65,536 rows at most
    n = np.zeros((256, 256))
    for g, c in pairs:
        n[g >> 8, g & 255] = c
    p = np.full((1, 256), 1 / 256)
    for seen in ((n > 0).sum(axis=0)[None, :], n):
        out = np.where(seen >= OFTEN, p, 0).sum(axis=1, keepdims=True)
        p = mixed(seen, np.broadcast_to(p, seen.shape), seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True), out)
    return p


def predicted(g: np.ndarray, c: np.ndarray, short: np.ndarray, order: int) -> np.ndarray:
    """The probability of each n-gram's last byte after the others. g: rising, all of a shard; c: counts, 0 where training texts have none."""
    seen = g[c > 0]
    below, low_p = None, None
    for k in range(2, order + 1):
        every = g if k == order else np.unique(g & mask(k + 1))
        here, n = (seen, c[c > 0]) if k == order else np.unique(np.unique(seen & mask(k + 2)) & mask(k + 1), return_counts=True)
        times = np.zeros(len(every))
        times[np.searchsorted(every, here)] = n
        low = short[every >> 8 & 255, every & 255] if below is None else low_p[np.searchsorted(below, every & mask(k))]
        context = every >> 8
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        summed = lambda x, first=first, m=len(every): np.repeat(np.add.reduceat(x, first), np.diff(np.r_[first, m]))
        low_p = mixed(times, low, summed(times), summed((times > 0).astype(float)), summed(np.where(times >= OFTEN, low, 0)))
        below = every
    return low_p


def shard_by_context(codes: np.ndarray, shards: int) -> np.ndarray:
    """Shards of turned n-grams by the last two bytes of their contexts, and of words."""
    return np.where(codes < 0, shard_of(codes, shards), (((codes >> 8 * (ORDER - 1) & 0xFFFF) * ODD) >> 4) % shards)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""
    small_batches(docs.sparkSession)
    held = F.coalesce(crc_mod5(key), F.lit(0)) == 1
    ready = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), held.alias("_held"))
    size = ready.agg(F.sum(F.octet_length("_text")).alias("n"), F.count_if(~F.col("_held")).alias("texts")).first()
    texts, blocks, shards = size["texts"], (size["n"] or 0) // BLOCK + 1, (size["n"] or 0) // SHARD_BYTES + 12
    placed = packed_texts(ready.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int")), "_text")

    def codes_of(batch: pa.RecordBatch):
        """A batch's words and n-grams; the number of words and the rows of both; and which are of training texts."""
        buf, offsets, word, row = sequence(*text_bytes(batch.column(0)))
        code, of = grams(buf, offsets, ORDER + 1)
        more = (batch.num_rows, len(word), np.r_[row, of].astype(np.int32))
        codes = np.r_[word, turned(code)]
        if batch.num_columns == 1:
            return codes, more
        return codes, more, ~batch.column(1).to_numpy(zero_copy_only=False)[more[2]]

    questions = written(asked(placed, "_text", shards, codes_of, shard_by_context, ("_held",)))
    packed = written(merged(questions, shards))
    found = unpacked_table(packed)
    sums = found.where("g < 0").agg(F.sum("v").alias("n"), F.count_if(F.col("v") > 0).alias("v")).first()
    train, different = (sums["n"] or 0) + texts, sums["v"] + (texts > 0)
    short = docs.sparkSession.sparkContext.broadcast(short_orders(found))  # 256 * 256 numbers
    free_shuffles(docs.sparkSession)  # those of the merge and of the sums
    rest = train + 0.5 * (different + 1)

    def solve(g: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts of words; log10 of n-grams' probabilities, positive."""
        whole = np.searchsorted(g, 0)
        out = c.astype(float)
        if whole < len(g):
            code = turned(g[whole:])
            by = np.argsort(code, kind="stable")
            out[whole + by] = -np.log10(predicted(code[by], c[whole:][by], short.value, ORDER))
        return out

    def add(group: pa.Table, parts) -> pa.Table:
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for (n, words, rows), values in parts:
            row, of, count = rows[:words], rows[words:], values[:words]
            out["n_tokens"].append(np.bincount(row, minlength=n) + 1)
            out["n_known"].append(np.bincount(row, count > 0, n) + (texts > 0))
            out["base_score"].append(np.bincount(row, np.log10((count + 0.5) / rest), n) + np.log10((texts + 0.5) / rest))
            out["score"].append(-np.bincount(of, values[words:], n))
        whole = ("n_tokens", "n_known")
        return pa.table({"_id": group.column("_id")} | {k: pa.array(np.concatenate(v or [np.zeros(0)]).astype(np.int64 if k in whole else float)) for k, v in out.items()})

    schema = T.StructType([T.StructField("_id", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    out = answered(placed, "_text", shards, packed, questions, codes_of, add, schema, solve, shard_by_context)
    out = out.withColumnRenamed("_id", key)
    return out.select(key, held.alias("held_out"), "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
