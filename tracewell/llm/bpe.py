"""Byte-pair encoding and decoding by a contiguous rank array.

A short word is a row of bytes. One array holds where its parts begin, a second the merge rank of each
part with the next one. A step looks for the smallest rank in the whole row, deletes the boundary between
those two parts, and looks up only the two ranks beside it anew; it ends when no pair has a rank. All words
of like length that a task has not met before take their steps together, as rows of one numpy matrix.

A word beyond 256 bytes takes all merges of the smallest rank in one pass (``Vocabulary.long_word``), as a boundary at a time would cost the square of its length;
the ids are the same, since a merge of rank r makes a part that only merges learnt after r can use, so that no smaller rank appears before the last pair of rank r is gone.

Texts are whole, however long. A null or empty text has no tokens. The special token's own string is one token
when it stands in a text, as in the vocabulary's library. Repeated rows are encoded row by row; extra columns
pass through ``encode``/``decode`` untouched, and an output column replaces an input column of its name. Rows with a null id are rows like others. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, release, small_batches, table

NO_RANK = np.int32(2**31 - 1)
#: A task's memory of words: emptied when it has so many, so that it stays under about 40 MB, and at the task's end.
REMEMBERED = 150_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, by letter."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Vocabulary:
    """Merges, ids and special tokens of one byte-level vocabulary file."""

    #: The published split of byte-level BPE: contractions, words, numbers, the rest, white space.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    #: The same split for texts of ASCII and Latin letters alone (the second pattern), where re does it three times as fast.
    LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ſ]+|\s+(?!\S)|\s+")
    LATIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ]*")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.first = np.array([ids[c] for c in sorted(letters, key=letters.get)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pair = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pair)
        self.size, self.pairs = size, pair[order]
        self.rank = order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        # An open-addressed table of the pairs: a lookup costs one or two reads, not a binary search.
        self.mask = (1 << (len(pair) * 4).bit_length()) - 1
        self.slot_pair, self.slot_rank = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NO_RANK, np.int32)
        left = np.arange(len(pair))
        at, self.probes = self.slot(pair), 0
        while len(left):
            free = self.slot_pair[at] < 0
            self.slot_pair[at[free]] = pair[left[free]]  # of several for one slot the last stays
            done = self.slot_pair[at] == pair[left]
            self.slot_rank[at[done]] = left[done]
            left, at = left[~done], (at[~done] + 1) & self.mask
            self.probes += 1

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; NO_RANK where there is none or an id is -1."""
        pair = left.astype(np.int64) * self.size + right
        pair[(left < 0) | (right < 0)] = -2
        at, out = self.slot(pair), np.full(len(pair), NO_RANK, np.int32)
        todo = np.arange(len(pair))
        for _ in range(self.probes):
            held = self.slot_pair[at]
            hit = held == pair[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (held >= 0)
            todo, at = todo[go], (at[go] + 1) & self.mask
            if not len(todo):
                break
        return out

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of words of like length: rows of one matrix, one deleted boundary a row and step."""
        n, width = len(words), max(map(len, words))
        joined = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        ids = np.full((n, width), -1, np.int32)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.first[joined]
        after = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), -1).astype(np.int32)
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        rank = np.full((n, width), NO_RANK, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(1)
            best = rank[rows, at]
            go = best < NO_RANK
            rows, at, best = rows[go], at[go], best[go]
            gone = after[rows, at]
            beyond = after[rows, gone]
            ids[rows, at] = self.merged[best]
            ids[rows, gone] = -1
            rank[rows, gone] = NO_RANK
            after[rows, at] = beyond
            has = beyond >= 0
            before[rows[has], beyond[has]] = at[has]
            right = np.where(has, ids[rows, beyond], -1)
            rank[rows, at] = self.ranks(ids[rows, at], right)
            prior = before[rows, at]
            has = prior >= 0
            rank[rows[has], prior[has]] = self.ranks(ids[rows[has], prior[has]], ids[rows[has], at[has]])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def long_word(self, word: bytes) -> tuple[int, ...]:
        """One word of any length: pairs of the smallest rank merge together, left to right, a pass each."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            rank = self.ranks(ids[:-1], ids[1:])
            best = rank.min()
            if best == NO_RANK:
                break
            hits = np.flatnonzero(rank == best)
            run = np.r_[True, np.diff(hits) > 1]
            first = np.maximum.accumulate(np.where(run, hits, 0))
            hits = hits[(hits - first) % 2 == 0]  # of aaa the first two merge
            ids = ids.copy()
            ids[hits] = self.merged[best]
            ids = np.delete(ids, hits + 1)
        return tuple(ids.tolist())

    def learn(self, words: set[str]) -> None:
        """Encodes the words not met before, grouped by length."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        by: dict[int, list[str]] = {}
        for w in words:
            if w not in self.known:
                by.setdefault((len(w.encode()) + 3) // 4, []).append(w)
        for width, group in by.items():
            if width > 64:
                for w in group:
                    self.known[w] = self.long_word(w.encode())
                continue
            step = max(1, 400_000 // (4 * width))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.known.update(zip(part, self.merge([w.encode() for w in part])))

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each whole text."""
        words = []
        for t in texts:
            split = (self.LATIN_SPLIT if self.LATIN.fullmatch(t or "") else self.SPLIT).findall
            parts = self.apart.split(t or "") if self.apart and any(s in (t or "") for s in self.special) else [t or ""]
            words.append([w for p in parts for w in ([p] if p in self.special else split(p))] if len(parts) > 1 else split(parts[0]))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set(chain.from_iterable(words)) - self.special.keys())
        known = self.known
        for s, i in self.special.items():
            known[s] = (i,)
        for w in words:
            yield list(chain.from_iterable(map(known.__getitem__, w)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _replaced(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with the array column ids: the tokens of the column text. With decoded, a column of that name has the SHA-256 of the
    text that the tokens decode to."""
    path = path or default_vocabulary()
    small_batches(df.sparkSession)
    df = df.drop(decoded) if decoded else df
    schema = _replaced(df, ids, T.ArrayType(T.IntegerType()))
    keep = [f.name for f in schema.fields[:-1]]
    names = [*keep, ids, *([decoded] if decoded else [])]
    schema = schema.add(decoded, T.StringType()) if decoded else schema

    def run(batches):
        v = vocabulary(path)
        for b in chunks(batches, text):
            got = list(v.encode(b.column(b.schema.get_field_index(text)).to_pylist()))
            more = [pa.array([hashlib.sha256(v.decode(i).encode()).hexdigest() for i in got], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(got, pa.list_(pa.int32())), *more], names=names)
        v.known.clear()
        release()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """df with the string column text: what the tokens of the array column ids spell. Null ids spell nothing."""
    path = path or default_vocabulary()
    schema = _replaced(df, text, T.StringType())
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            got = pa.array([v.decode(i or []) for i in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), got], names=[*keep, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: the number of tokens, and digests of the ids and of the text that they decode to."""
    small_batches(df.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        v = vocabulary(path)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for b in chunks(batches, "_text"):
            n, of_ids, of_text = [], [], []
            for ids in v.encode(b.column(1).to_pylist()):
                n.append(len(ids))
                of_ids.append(sha(",".join(map(v.decimal.__getitem__, ids)).encode()))
                of_text.append(sha(v.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        v.known.clear()
        release()

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
