"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``GRAM`` bytes triggers: in every window of ``LENGTH`` bytes the gram of the least hash is its trigger, so
that equal windows trigger at equal places, whatever surrounds them, and no window is without one (a residue of the hash would leave
windows without). A phrase runs from the first window of a trigger to the trigger's end; the parse is the sequence of phrases of a text.

1. The parse goes to shards by trigger, which answer the triggers that stand in more than one block of documents. Others cannot
   lie in a repeated window across blocks, and their phrases go no further.
2. The phrases left form the dictionary, sharded by trigger: each with what follows it in its text as far as one of its windows
   reaches (the beginning of the rest of the parse), its document and its place.
3. Each shard builds the suffix array of its dictionary (the suffixes at which windows begin) and that of the parse (what
   follows the phrases, with longest common prefixes). A window is a suffix of a phrase and the beginning of what follows, so rank
   in the one, then rank in the other bring all windows into the order of the corpus. Neighbours that share ``LENGTH`` bytes are one
   group, and a window is removed if its group has a smaller document. All comparisons here are of bytes.

The order of the whole corpus lies in shards, as equal windows have equal triggers. Copies cost little: a block of documents sends equal phrases with equal
surroundings once. A trigger with more than one in ``SHARE`` of all places (a boilerplate line) is dealt window by window, by the suffix
of its phrase, so that no shard gathers it.

Matches never cross texts. Null and empty texts have no bytes. Rows of one id are told apart by their text and never
match each other; repeated rows get the same spans. Rows with a null id match nothing and are kept whole. Very long texts are worked on in
slices, but stand in memory as a whole, with their block. Extra columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gathered, mix, powers, prefix_hash, release, small_batches, span_hash, table, text_bytes

LENGTH, GRAM = 50, 20
#: Bytes of text in a block of documents, and behind a shard of the dictionary; entries that a task holds before it sends them.
BLOCK, SHARD, HELD = 4 << 20, 4 << 20, 300_000
#: A trigger is dealt window by window if it has more than one in SHARE of all places, but not below LEAST_HOT nor, as its phrases stand in
#: the memory of a task, beyond MOST_HOT.
SHARE, LEAST_HOT, MOST_HOT = 16_384, 1000, 1_000_000
#: Places hashed, phrases ordered and windows expanded at a time.
SLICE, PHRASES, WINDOWS = 1 << 18, 8192, 500_000
LOW48 = np.uint64((1 << 48) - 1)


# ---- triggers ---------------------------------------------------------------------------------------------------


def occurrences(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The triggers of all texts in order: place, first and last start of the windows that it is the trigger of, and its hash."""
    n, wide = len(buf), length - gram + 1
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    valid = np.ones(max(0, n - length + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        valid[max(a, b - length + 1) : b] = False
    for low in range(0, len(valid), SLICE):
        high = min(low + SLICE, len(valid))
        sums = prefix_hash(buf[low : high + length - 1])
        _, down = powers(len(sums))
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties: the first place
        least, size = key, 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < wide:
            least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
        start = np.flatnonzero(valid[low:high])
        if not len(start):
            continue
        at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.r_[True, at[1:] != at[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        out.append((at[first] + low, start[first] + low, start[last] + low, h[at[first]]))
    return tuple(map(np.concatenate, zip(*out)))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for starts in order."""
    out = np.zeros(len(start), np.uint64)
    longest = int((end - start).max()) if len(start) else 0
    for low in range(0, len(buf), SLICE):
        i, j = np.searchsorted(start, (low, low + SLICE))
        if i < j:
            sums = prefix_hash(buf[low : low + SLICE + longest])
            out[i:j] = span_hash(sums, start[i:j] - low, end[i:j] - low)
    return out


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]


def least_of(by: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the document of its run's first, where by brings rows into an order with runs that begin at new."""
    out = np.empty(len(by), doc.dtype)
    out[by] = doc[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return out


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(n: int, raw: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of n entries each that raw holds, and what is left as bytes."""
    raw, out, at = zstandard.decompress(raw), [], 0
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)  # of hashes cut to 48 bits


# ---- which triggers are repeated --------------------------------------------------------------------------------


def parse(docs: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, n, entries): the triggers of each shard with the blocks that they stand in, and how often, packed."""

    def flush(h, block):
        h, block = np.concatenate(h) & LOW48, np.concatenate(block)
        shard = shard_of(h, shards)
        by = np.lexsort((h, block, shard))
        h, block, shard = h[by], block[by], shard[by]
        first = np.flatnonzero(runs(h, block, shard))
        times = np.diff(np.r_[first, len(h)]).astype(np.int32)
        h, block, shard = h[first], block[first], shard[first]
        cut = np.flatnonzero(np.r_[runs(shard), True])
        six = h.view(np.uint8).reshape(-1, 8)[:, :6]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), pa.array([pack(np.diff(block[a:b], prepend=0).astype(np.int32), times[a:b], six[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
            names=["shard", "n", "entries"],
        )

    def run(batches):
        h, block, held = [], [], 0
        for b in chunks(batches):
            buf, offsets = text_bytes(b.column(1))
            at, _, _, got = occurrences(buf, offsets, length)
            h.append(got)
            block.append(b.column(0).to_numpy()[np.searchsorted(offsets, at, "right") - 1].astype(np.int32))
            held += len(at)
            if held > HELD:
                yield from flush(h, block)
                h, block, held = [], [], 0
        if held:
            yield from flush(h, block)

    return docs.select("block", "text").mapInArrow(run, "shard int, n int, entries binary")


def repeated(parsed: DataFrame, hot: int) -> DataFrame:
    """(block, n, grams): for each block of documents, its triggers that stand in another block as well, those with more than hot places marked."""

    def run(group: pa.Table) -> pa.Table:
        h, block, times = [], [], []
        for n, raw in zip(group.column("n").to_pylist(), group.column("entries").to_pylist()):
            step, often, six = unpack(n, raw, np.int32, np.int32)
            eight = np.zeros((n, 8), np.uint8)
            eight[:, :6] = six.reshape(n, 6)
            h.append(eight.view(np.uint64).ravel())
            block.append(np.cumsum(step, dtype=np.int32))
            times.append(often)
        h, block, times = map(np.concatenate, (h, block, times))
        by = np.lexsort((block, h))
        h, block, times = h[by], block[by], times[by]
        group_at = np.cumsum(runs(h)) - 1
        often = np.bincount(group_at, times)
        new = runs(h, block)
        h, block, group_at = h[new], block[new], group_at[new]
        many = np.bincount(group_at)[group_at] > 1
        code = h[many] | (np.uint64(1 << 63) * (often[group_at[many]] > hot))
        block = block[many]
        by = np.argsort(block, kind="stable")
        code, block = code[by], block[by]
        del h, times, group_at, often, new, many, by
        release()
        cut = np.flatnonzero(np.r_[runs(block), True]) if len(block) else np.zeros(1, int)
        return pa.table({"block": pa.array(block[cut[:-1]], pa.int32()), "n": pa.array(np.diff(cut), pa.int32()), "grams": pa.array([pack(code[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    return parsed.groupBy("shard").applyInArrow(run, "block int, n int, grams binary")


# ---- phrases and what follows them ------------------------------------------------------------------------------


def in_order(docs: pa.Table) -> pa.Table:
    """A block's documents in an order that does not depend on how they came; a document's number in it is its name inside the block."""
    return docs.take(np.lexsort((docs.column("doc_id").to_numpy(), docs.column("row_key").to_numpy())))


def phrases(docs: DataFrame, answers: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, block, n, packed): repeated phrases with what follows them, for the shards that order them.

    Inside a block equal phrases with equal surroundings are sent once, for the least document; all windows of the others are known to be
    repeated, and their spans go along as they are (n below 0)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"shard": [], "block": [], "n": [], "packed": []}
        if left.num_rows:
            codes = [unpack(n, raw, np.uint64)[0] for n, raw in zip(right.column("n").to_pylist(), right.column("grams").to_pylist())]
            block, left = left.column("block")[0].as_py(), in_order(left.select(["block", "doc_id", "row_key", "text"]))
            for shard, n, packed in block_phrases(left, np.concatenate(codes) if codes else np.zeros(0, np.uint64)):
                for name, x in zip(out, (block % shards if shard is None else shard, block, n, packed)):
                    out[name].append(x)
            del left, codes
        release()
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "packed": pa.array(out["packed"], pa.binary())})

    def block_phrases(left, codes):
        ids = left.column("doc_id").to_numpy()
        buf, offsets = text_bytes(left.column("text"))
        at, lo, hi, h = occurrences(buf, offsets, length)
        h &= LOW48
        row = np.searchsorted(offsets, at, "right") - 1
        doc = ids[row]
        # Triggers of two documents of this block are repeated too.
        by = np.lexsort((doc, h))
        start = np.flatnonzero(runs(h[by]))
        last = np.r_[start[1:], len(h)] - 1
        here = h[by][start][doc[by][start] < doc[by][last]] if len(h) else h
        known = np.union1d(codes & LOW48, here)
        hot = np.sort(codes[codes >> np.uint64(63) > 0] & LOW48)
        pick = np.isin(h, known)
        at, lo, hi, h, row, doc = (x[pick] for x in (at, lo, hi, h, row, doc))
        is_hot = np.isin(h, hot)
        spans = []
        yield from sent(buf, offsets, at[~is_hot], lo[~is_hot], hi[~is_hot], shard_of(h[~is_hot], shards), row[~is_hot], doc[~is_hot], spans)
        # Hot triggers: each window by itself, a part of the triggers at a time.
        at, lo, hi, h, row, doc = (x[is_hot] for x in (at, lo, hi, h, row, doc))
        parts = np.uint64((hi - lo + 1).sum() // WINDOWS + 1)
        for part in range(int(parts)):
            mine = np.flatnonzero(h % parts == np.uint64(part))
            size = (hi - lo + 1)[mine]
            if not len(size):
                continue
            of = np.repeat(mine, size)
            s = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[of]
            suffix = hashes(buf, s, at[of] + GRAM) & LOW48
            yield from sent(buf, offsets, at[of], s, s, shard_of(suffix, shards), row[of], doc[of], spans)
        if spans:
            spans = np.concatenate(spans)
            yield None, -len(spans), pack(*spans.T.astype(np.int32))

    def sent(buf, offsets, at, lo, hi, shard, row, doc, spans):
        end = hi + length
        print_ = mix(hashes(buf, lo, end) + (at - lo).astype(np.uint64))
        by = np.lexsort((doc, print_))
        later = doc > least_of(by, runs(print_[by]), doc)
        spans.append(np.stack([row, lo - offsets[row], end - offsets[row]], 1)[later])
        by = np.flatnonzero(~later)
        by = by[np.argsort(shard[by], kind="stable")]
        cut = np.flatnonzero(np.r_[runs(shard[by]), True]) if len(by) else np.zeros(1, int)
        for a, b in zip(cut[:-1], cut[1:]):
            for k in range(a, b, 4 * PHRASES):
                i = by[k : min(b, k + 4 * PHRASES)]
                text = gathered(buf, lo[i], end[i] - lo[i])
                yield int(shard[i[0]]), len(i), pack(doc[i], row[i].astype(np.int32), (lo - offsets[row])[i].astype(np.int32), (at - lo)[i].astype(np.uint8), (hi - lo + 1)[i].astype(np.uint8), text)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "shard int, block int, n int, packed binary")


# ---- suffix arrays ----------------------------------------------------------------------------------------------


def sorted_ranks(strings: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (rows of bytes, zero beyond their size) in order: the order, where a new one begins in it, and each row's rank; equal rows have one rank."""
    n = len(strings)
    words = [np.ascontiguousarray(strings[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, strings.shape[1], 8)] + [size.astype(np.uint64)]
    order = np.argsort(words[0], kind="stable")
    new = runs(words[0][order])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    for word in words[1:]:
        alone = new & np.r_[new[1:], True]
        place = np.flatnonzero(~alone)
        if not len(place):
            break
        at = order[place]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))[place]  # groups stay where they are
        inner = np.lexsort((word[at], head))
        at, head = at[inner], head[inner]
        order[place] = at
        new[place] = runs(head, word[at])
    rank[order] = np.cumsum(new) - 1
    return order, new, rank


def rows_of(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The spans of flat as rows of width bytes, zero beyond their size."""
    place, out = np.arange(width), np.empty((len(start), width), flat.dtype)
    for low in range(0, len(start), PHRASES):  # places take eight times the room of bytes
        part = slice(low, low + PHRASES)
        out[part] = flat[np.minimum(start[part, None] + place, len(flat) - 1)]
        out[part][place >= size[part, None]] = 0
    return out


def repeated_windows(flat, begin, before, count, doc, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase of one lot of triggers its first and last window (from 0) whose group has a smaller document; -1 without one.

    A phrase is flat[begin : begin + before + gram]; its count windows begin there and at the bytes after."""
    wide = (length + 7) // 8 * 8 + 8
    cut = before + gram
    _, _, phrase = sorted_ranks(rows_of(flat, begin, cut, wide), cut)
    # The dictionary's suffix array, of the suffixes at which windows begin.
    of = np.repeat(np.arange(len(begin)), count)
    o = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    code, at, suffix = np.unique(phrase[of] * 64 + o, return_index=True, return_inverse=True)
    size = cut[of[at]] - o[at]
    _, _, rank = sorted_ranks(rows_of(flat, begin[of[at]] + o[at], size, wide), size)
    rank = rank[suffix]
    # The parse's: what follows, as far as the last window reaches, with longest common prefixes.
    follow = count + length - 1 - cut
    strings = rows_of(flat, begin + cut, follow, (length - gram + 7) // 8 * 8)
    order, _, _ = sorted_ranks(strings, follow)
    differ = strings[order[1:]] != strings[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), length)
    shared = np.minimum(shared, np.minimum(follow[order[1:]], follow[order[:-1]]))
    upto = np.zeros((length - gram + 1, len(order)), np.int64)  # for each number of bytes, the group in the parse's order
    for k in range(1, length - gram + 1):
        upto[k, order] = np.r_[0, np.cumsum(shared < k)]
    # Both together: the order of the corpus.
    place = rank * len(order) + upto[length - gram - (before[of] - o), of]
    by = np.lexsort((doc[of], place))
    hit = least_of(by, runs(place[by]), doc[of]) < doc[of]
    first, last = np.full(len(begin), 255), np.full(len(begin), -1)
    np.minimum.at(first, of[hit], o[hit])
    np.maximum.at(last, of[hit], o[hit])
    return np.where(last < 0, -1, first), last


def ordered_spans(dictionary: DataFrame, length: int) -> DataFrame:
    """(block, n, spans): the bytes of each text that windows of a smaller document cover, one span for each phrase, packed."""

    def run(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        ready = group.filter(pa.array(n < 0))
        ready = pa.table({"block": ready.column("block"), "n": pa.array(-n[n < 0], pa.int32()), "spans": ready.column("packed")})
        group = group.filter(pa.array(n > 0))
        if not group.num_rows:
            return ready
        ns, packed = group.column("n").to_pylist(), group.column("packed").to_pylist()
        pieces = list(zip(*(unpack(n, raw, np.int64, np.int32, np.int32, np.uint8, np.uint8) for n, raw in zip(ns, packed))))
        block = np.repeat(group.column("block").to_numpy(), ns)
        doc, row, place, before, count, flat = map(np.concatenate, pieces)
        before, count = before.astype(np.int64), count.astype(np.int64)
        size = count + length - 1
        begin = np.cumsum(size) - size
        trigger = hashes(flat, begin + before, begin + before + GRAM)
        by = np.argsort(trigger, kind="stable")
        edge = np.flatnonzero(np.r_[runs(trigger[by]), True])
        first, last, at = np.full(len(by), -1), np.full(len(by), -1), 0
        while at < len(by):  # lots of whole triggers
            upto = edge[np.searchsorted(edge, at + PHRASES, "right") - 1]
            upto = upto if upto > at else edge[np.searchsorted(edge, at, "right")]  # a trigger with more phrases
            i = by[at:upto]
            first[i], last[i] = repeated_windows(flat, begin[i], before[i], count[i], doc[i], length)
            at = upto
        hit = np.flatnonzero(last >= 0)
        hit = hit[np.argsort(block[hit], kind="stable")]
        cut = np.flatnonzero(np.r_[runs(block[hit]), True]) if len(hit) else np.zeros(1, int)
        spans = [pack(row[i], (place + first)[i].astype(np.int32), (place + last + length)[i].astype(np.int32)) for i in (hit[a:b] for a, b in zip(cut[:-1], cut[1:]))]
        del pieces, flat, trigger, by, doc, before, count, size, begin
        release()
        return pa.concat_tables([ready, pa.table({"block": pa.array(block[hit[cut[:-1]]], pa.int32()), "n": pa.array(np.diff(cut), pa.int32()), "spans": pa.array(spans, pa.binary())})])

    return dictionary.groupBy("shard").applyInArrow(run, "block int, n int, spans binary")


# ---- what is left -----------------------------------------------------------------------------------------------


def _cut(text: bytes, spans: np.ndarray, whole: bool) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of text, and the maximal removed spans (touching ones are one). With whole, a character cut in part goes whole."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    merged: list[list[int]] = []
    for a, b in spans.tolist():
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in [*merged, [len(text), 0]]:
        piece = text[at:a]
        # Each piece by itself: the end of one and the beginning of the next must not meet as a character that was in no text.
        kept.append(piece.decode("utf-8", "ignore").encode() if whole else piece)
        at = b
    return b"".join(kept), [tuple(m) for m in merged]


def _deduplicated(docs: DataFrame, key: str, text: str, length: int, carry: tuple[str, ...], whole: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, spans, and the columns to carry as _0, _1, ..."""
    small_batches(docs.sparkSession)
    extra = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    names = [f"_{i}" for i in range(len(carry))]
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks, shards = total // BLOCK + 7, total // SHARD + 3
    hot = min(max(LEAST_HOT, 2 * total // (length - GRAM + 2) // SHARE), MOST_HOT)
    ready = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)
    ready = ready.withColumn("block", F.pmod("row_key", F.lit(blocks)).cast("int"))
    real = ready.where("doc_id is not null")
    answers = repeated(parse(real, shards, length), hot)
    spans = ordered_spans(phrases(real, answers, shards, length), length)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, stop: long>>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            left = in_order(left)
        got = [np.stack(unpack(n, raw, np.int32, np.int32, np.int32)[:3], 1) for n, raw in zip(right.column("n").to_pylist(), right.column("spans").to_pylist())]
        where = np.concatenate(got) if got else np.zeros((0, 3), np.int32)
        where = where[np.argsort(where[:, 0], kind="stable")]
        edge = np.searchsorted(where[:, 0], np.arange(left.num_rows + 1))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
        for i, t in enumerate(left.column("text")):
            t = t.as_buffer().to_pybytes()
            kept, cuts = _cut(t, where[edge[i] : edge[i + 1], 1:], whole)
            for name, x in zip(out, (len(t), sum(b - a for a, b in cuts), len(cuts), kept, [{"start": a, "stop": b} for a, b in cuts])):
                out[name].append(x)
        release()
        return pa.table({"doc_id": left.column("doc_id")} | {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))} | {c: left.column(c) for c in names})

    more = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry))
    found = real.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, fields + more)
    unmatched = ready.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"), F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("spans"), *names)
    return found.unionByName(unmatched)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: its id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and the spans of removed bytes."""
    return _deduplicated(docs, key, text, length, (), False).withColumnRenamed("doc_id", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes gone from the text; a character of which only some bytes would stay goes whole.

    Texts stay as rows even if nothing is left of them; a null text becomes an empty one."""
    carry = tuple(c for c in docs.columns if c not in (key, text))
    found = _deduplicated(docs, key, text, length, carry, True)
    back = {key: F.col("doc_id"), text: F.col("kept").cast("string")} | {c: F.col(f"_{i}") for i, c in enumerate(carry)}
    return found.select(*(back[c].alias(c) for c in docs.columns))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
