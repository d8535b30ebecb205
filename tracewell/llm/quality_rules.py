"""Quality rules on repetition inside a text, from a suffix array over its words.

The suffix array is built by prefix doubling, for all texts of a batch at once: words of different texts get
different ranks, so that no suffix compares equal across texts. The ranks of every doubling step are kept;
walking them from the longest step down gives the common prefix of neighbours in the suffix array. An interval
of that array with common prefix l is a substring of l words that occurs more than once, and the longest
repeat that starts at a word is the larger of its two neighbours' values. Their spans are united; a text is
kept if they cover little of it and the longest is short.

A null or empty text, or one without words, has no words and fails the base rule (fewer than 10 words). Texts are measured whole: a task works on about a megabyte of
text at a time, or on one longer text with log2(its repeats) arrays of its words. Repeated rows are measured each, rows with a null id too. A text exactly at a limit
passes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, prefix_hash, small_batches, span_hash, table, text_bytes, word_spans

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: A repeat counts from so many words; its spans may cover so many hundredths of the words; the longest allowed.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 20, 100
WINDOW = 5


def doubled_ranks(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all rows' words, and the ranks by the first 1, 2, 4, ... words."""
    n = len(word)
    end = np.append(np.flatnonzero(np.diff(row)) + 1, n)[np.cumsum(np.r_[0, np.diff(row) != 0])] if n else np.zeros(0, int)
    order = np.lexsort((word, row))
    new = np.r_[True, (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        head = np.flatnonzero(new)
        open_ = np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n]))  # in order of the suffix array
        if not open_.any():
            return order, levels
        place = np.flatnonzero(open_)
        at = order[place]
        ahead = at + step
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[at]
        inner = np.lexsort((second, first))
        at, first, second = at[inner], first[inner], second[inner]
        order[place] = at
        # A suffix that ends exactly is alone: another of its group that ends there would be the same suffix.
        split = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (second[1:] == 0)]
        new[place] = split
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(split, place, 0))
        levels.append(rank)
        step *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], row: np.ndarray) -> np.ndarray:
    """For each place of the suffix array but the first, the words shared with the place before."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(max(0, n - 1), np.int64)
    same_row = row[a] == row[b] if n > 1 else np.zeros(0, bool)
    for k in range(len(levels) - 1, -1, -1):
        ok = same_row & (a < n) & (b < n)
        i, j = np.where(ok, a, 0), np.where(ok, b, 0)
        hit = ok & (row[i] == row[j]) & (row[i] == row[order[1:]]) & (levels[k][i] == levels[k][j]) & (i != j)
        step = 1 << k
        out[hit] += step
        a[hit] += step
        b[hit] += step
    return out


def longest_repeats(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeated substring that starts there."""
    longest = np.zeros(len(word), np.int64)
    if len(word) > 1:
        order, levels = doubled_ranks(word, row)
        shared = common_prefixes(order, levels, row)
        np.maximum.at(longest, order[1:], shared)
        np.maximum.at(longest, order[:-1], shared)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words the repeats of at least so many words cover."""
    edge = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of every row of one batch."""
    rows = len(offsets) - 1
    start, end, row = word_spans(buf, offsets)
    sums = prefix_hash(buf)
    upto = lambda mask: np.r_[0, np.cumsum(mask)][offsets]
    letters = np.zeros(len(buf) + 1, np.int64)
    np.add.at(letters, start, 1)
    np.add.at(letters, end, -1)
    in_word = np.cumsum(letters[:-1]) > 0
    line_end = np.zeros(len(buf), bool)
    line_end[buf == 10] = True
    cuts = np.flatnonzero(line_end)
    begin = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], cuts + 1])
    begin = begin[begin < len(buf)]
    # An empty last line begins where the next row does; it holds no word, so that row's own line is meant.
    stop = np.r_[begin[1:], len(buf)]
    stop = stop - ((stop > begin) & (buf[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    words_upto = np.r_[0, np.cumsum(in_word)]
    full = words_upto[stop] > words_upto[begin]
    begin, stop = begin[full], stop[full]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    line = span_hash(sums, begin, stop)
    by = np.lexsort((line, line_row))
    again = (line[by][1:] == line[by][:-1]) & (line_row[by][1:] == line_row[by][:-1])
    longest = longest_repeats(span_hash(sums, start, end), row)
    count = lambda at, w=None: np.bincount(at, w, rows).astype(np.int64)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row, longest)
    out = {
        "n_words": count(row),
        "word_chars": np.diff(upto(in_word & ((buf & 0xC0) != 0x80))),
        "n_symbols": np.diff(upto(SYMBOL[buf])),
        "n_dup_lines": count(line_row[by][1:][again]),
        "n_repeat_words": count(row, covered(longest, WINDOW)),
        "n_covered_words": count(row, covered(longest, MIN_REPEAT)),
        "longest_repeat": most,
    }
    return out


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Per row of df: its counts, base_failed, and kept. max_covered is in hundredths of the words."""
    small_batches(df.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]

    def run(batches):
        for b in chunks(batches, "_text"):
            got = measure(*text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[n], pa.int64()) for n in names)], names=[key, *names])

    schema = T.StructType([df.schema[key], *(T.StructField(n, T.LongType()) for n in names)])
    found = df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = (100 * F.col("n_covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
