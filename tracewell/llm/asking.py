"""Documents that need numbers from a table that grows with them: blocks of documents ask its shards.

Texts go in blocks, compressed. A block asks for its different codes only, packed by shard; the shards answer in the same
order, and the block works with an array of numbers. Nothing of the table is broadcast, and no row is made for each place of a text. The table moves once: a
shard's rows are sorted before the questions that it gets, and it answers those one after the other as they stream past.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, release

#: Bytes of text in a block, codes in a shard of the table, rows of the table that a task packs together.
BLOCK, SHARD, PACK = 8 << 20, 1 << 20, 1 << 19
#: Codes of a block's texts that are sorted at a time.
SORTED = 3 << 20
#: Odd numbers of 20 bits that spread codes over shards.
ODD, ODDER = 742_039, 968_137


def shard_of(code, shards: int):
    """The shard of a code of up to 60 bits, or of a negative one, as a column or an array: products stay within 63 bits."""
    if isinstance(code, Column):
        return F.pmod(F.shiftright(code.bitwiseAND((1 << 28) - 1) * F.lit(ODD) + F.shiftright(code, 28) * F.lit(ODDER), 17), F.lit(shards)).cast("int")
    return (((code & ((1 << 28) - 1)) * ODD + (code >> 28) * ODDER) >> 17) % shards


def grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the n-gram of order bytes that ends at each byte, and its row; a text begins after line ends."""
    code, wide = buf.astype(np.int64), 1
    back = lambda x, n: np.r_[np.zeros(min(n, len(x)), np.int64), x[:-n]]
    while 2 * wide <= order:
        code |= back(code, wide) << (8 * wide)
        wide *= 2
    if wide < order:
        code |= (back(code, wide) & mask(order - wide)) << (8 * wide)
    # The first places of a row, over the end of the row before.
    at = (offsets[:-1, None] + np.arange(order - 1))
    at, place = at[at < offsets[1:, None]], np.broadcast_to(np.arange(order - 1), at.shape)[at < offsets[1:, None]]
    own = buf[at].astype(np.int64)
    for n in range(1, order):
        own |= np.where(place >= n, buf[np.maximum(at - n, 0)].astype(np.int64), 10) << (8 * n)
    code[at] = own
    return code, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mask(k: int) -> int:
    return (1 << (8 * k)) - 1


def packed_texts(docs: DataFrame, text: str, keep: np.ndarray | None = None, place: str | None = None) -> DataFrame:
    """docs with each text compressed; with keep, only rows whose column place is set in that bit map (place is not returned)."""
    fields = [f for f in docs.schema.fields if f.name != place]
    shared = docs.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in chunks(batches, text):
            if shared is not None:
                at = b.column(b.schema.get_field_index(place)).to_numpy()
                b = b.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))
            small = pa.array([squeeze(t.as_buffer()) if t.is_valid else None for t in b.column(b.schema.get_field_index(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([small if f.name == text else b.column(b.schema.get_field_index(f.name)) for f in fields], names=[f.name for f in fields])
        release()

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in fields]))


def unpacked(batches, text: str):
    """Batches of compressed texts as batches of texts, in slices."""
    spread = zstandard.ZstdDecompressor().decompress
    for b in batches:
        at = b.schema.get_field_index(text)
        for low in range(0, b.num_rows, 256):
            part = b.slice(low, 256)
            texts = pa.array([spread(t.as_buffer()) if t.is_valid else None for t in part.column(at)], pa.binary()).cast(pa.string())
            yield from chunks([pa.RecordBatch.from_arrays([texts if i == at else part.column(i) for i in range(part.num_columns)], names=part.schema.names)], text)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of one width, compressed plane by plane: the first bytes of sorted codes are runs, and the last ones are letters."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 3)


def unsqueezed(raw: bytes, kind=np.int64) -> np.ndarray:
    planes, wide = np.frombuffer(zstandard.decompress(raw), np.uint8), np.dtype(kind).itemsize
    planes = planes.reshape(wide, len(planes) // wide)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeezed_doubles(values: np.ndarray) -> bytes:
    """Doubles, compressed without loss: the different ones by the steps between their rising bit patterns, then each value's place among them."""
    different, at = np.unique(np.ascontiguousarray(values, np.float64).view(np.int64), return_inverse=True)
    steps = squeezed(np.diff(different, prepend=np.int64(0)))
    return len(steps).to_bytes(8, "little") + steps + squeezed(at.astype(np.int32))


def unsqueezed_doubles(raw: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(raw[:8], "little")
    return np.cumsum(unsqueezed(raw[8:end])).view(np.float64)[unsqueezed(raw[end:], np.int32)]


NONE = np.int64(-(1 << 63))


class Bag:
    """Different codes with counts: an open-addressed table, where to add or find a code costs a read or two and no sort."""

    def __init__(self, codes: np.ndarray | None = None):
        self.bits, self.held = 12, 0
        self.code, self.count = np.full(1 << 12, NONE), np.zeros(1 << 12, np.int64)
        if codes is not None:
            self.add(codes, 0)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code; those that are new take one."""
        out, mask = self.slot(codes), (1 << self.bits) - 1
        todo = np.flatnonzero(self.code[out] != codes)  # most have been met, and stand in the first slot
        at = out[todo]
        while len(todo):
            mine = codes[todo]
            free = self.code[at] == NONE
            self.code[at[free]] = mine[free]  # of several for one slot the last stays
            go = self.code[at] != mine
            out[todo[~go]] = at[~go]
            todo, at = todo[go], (at[go] + 1) & mask
        return out

    def add(self, codes: np.ndarray, count: int) -> None:
        for low in range(0, len(codes), 1 << 18):
            part = codes[low : low + (1 << 18)]
            while 2 * (self.held + len(part)) > 1 << self.bits:  # at most half full
                codes_, counts_ = self.all()
                self.held = len(codes_)
                if 2 * (self.held + len(part)) <= 1 << self.bits:
                    break
                self.bits += 1
                self.code, self.count = np.full(1 << self.bits, NONE), np.zeros(1 << self.bits, np.int64)
                self.count[self.places(codes_)] = counts_
            at = self.places(part)
            self.held += len(part)  # a bound; counted exactly before the table grows
            if count:
                np.add.at(self.count, at, count)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        there = self.code != NONE
        return self.code[there], self.count[there]


class Tally:
    """Counts of codes that a task holds until there are many."""

    def __init__(self, most: int = 1 << 19):
        self.most, self.bag = most, Bag()

    def add(self, codes: np.ndarray, count: int = 1):
        self.bag.add(codes, count)
        if self.bag.bits > self.most.bit_length() and len(self.bag.all()[0]) > self.most:
            yield from self.rest()

    def rest(self):
        codes, counts = self.bag.all()
        self.bag = Bag()
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["g", "c"])


class Places:
    """Places of codes in an array, for at most so many different ones: a table that never grows, so that a code's place is known when it is first met."""

    def __init__(self, most: int):
        self.bag = Bag()
        self.bag.bits = max(12, (2 * most + 1).bit_length())
        self.bag.code, self.bag.count = np.full(1 << self.bag.bits, NONE), np.zeros(1 << self.bag.bits, np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(self.bag.places(codes[at : at + (1 << 18)]).astype(np.int32) for at in range(0, len(codes), 1 << 18))])

    def met(self) -> tuple[np.ndarray, np.ndarray]:
        """The different codes and their places."""
        at = np.flatnonzero(self.bag.code != NONE)
        return self.bag.code[at], at


def by_shard(codes: np.ndarray, shards: int, shard) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts codes by shard and code, and where each shard's part of it ends."""
    order = np.argsort(codes)
    of = shard(codes[order], shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)
    by = np.argsort(of, kind="stable")  # of short numbers by digits
    return order[by], np.searchsorted(of[by], np.arange(shards + 1))


def tallied(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of codes (62 bits and a sign) times two, and one more where a code counts: the different codes, rising, and how often each counts. One sort in place, and no table."""
    both.sort()
    first = np.flatnonzero(np.r_[True, (both[1:] ^ both[:-1]).view(np.uint64) > 1][: len(both)])
    codes = both[first] >> 1
    both &= 1
    return codes, np.add.reduceat(both, first) if len(first) else first


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of parts, rising, with the sums of their counts."""
    g, c = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    order = np.argsort(g)
    g, c = g[order], c[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
    return g[first], np.add.reduceat(c, first) if len(first) else c


def packed_table(table: DataFrame, shards: int, shard) -> DataFrame:
    """(shard, block: -1, codes, numbers): the table (g, v) in pieces, one for each task and shard or more."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def pack():
            g, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            order, ends = by_shard(g, shards, shard)
            rows = [(s, squeezed(g[order[a:b]]), squeezed(v[order[a:b]])) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([-1] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["shard", "block", "codes", "numbers"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield pack()
        if held:
            yield pack()
        release()

    return table.select("g", "v").mapInArrow(run, "shard int, block int, codes binary, numbers binary")


QUESTION = "shard int, block int, codes binary, numbers binary"


def asked(ready: DataFrame, text: str, shards: int, codes_of: Callable, shard: Callable = shard_of, columns: tuple[str, ...] = ()) -> DataFrame:
    """(shard, block, codes, numbers): each block's different codes by shard, with their counts where codes_of says what counts.

    codes_of(batch), of a batch with the texts and the columns named, gives the codes and what goes with them; or three arrays, of which the last says which codes count."""

    def ask(group: pa.Table) -> pa.Table:
        raw, held, counted = [], [(np.zeros(0, np.int64),) * 2], False

        def tally():
            both = np.concatenate(raw)
            raw.clear()
            held.append(tallied(both))

        for b in unpacked(group.select([text, *columns]).to_batches(), text):
            codes, _, *counts = codes_of(b)
            counted |= bool(counts)
            raw.append(codes << 1 | counts[0] if counts else codes << 1)
            if sum(map(len, raw)) > SORTED:
                tally()
            if sum(len(x[0]) for x in held[1:]) > max(SORTED, len(held[0][0])):
                held[:] = [summed(held)]
        if raw:
            tally()
        codes, counts = summed(held)
        held.clear()
        order, ends = by_shard(codes, shards, shard)
        block = group.column("_block")[0].as_py()
        rows = [(s, block, squeezed(codes[at]), squeezed(counts[at].astype(np.int32)) if counted else None) for s, at in ((s, order[a:b]) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b)]
        release()
        return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("shard", pa.int32()), ("block", pa.int32()), ("codes", pa.binary()), ("numbers", pa.binary())))})

    return ready.groupBy("_block").applyInArrow(ask, QUESTION)


def merged(questions: DataFrame, shards: int) -> DataFrame:
    """(shard, block: -1, codes, numbers): the different codes of all blocks with the sums of their counts, a row or a few for each shard."""

    def run(batches):
        at, held = None, []

        def row(g, c):
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([-1], pa.int32()), pa.array([squeezed(g)], pa.binary()), pa.array([squeezed(c)], pa.binary())], names=["shard", "block", "codes", "numbers"])

        for batch in batches:
            for s, codes, numbers in zip(*(batch.column(i) for i in (0, 2, 3))):
                if s.as_py() != at:
                    if held:
                        yield row(*summed(held))
                    at, held = s.as_py(), []
                held.append((unsqueezed(codes.as_buffer()), unsqueezed(numbers.as_buffer(), np.int32).astype(np.int64)))
                if len(held) > 1 and sum(len(x[0]) for x in held[1:]) > max(PACK, len(held[0][0])):
                    held = [summed(held)]
        if held:
            yield row(*summed(held))
        release()

    return questions.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, QUESTION)


def unpacked_table(df: DataFrame, number=np.int64) -> DataFrame:
    """(g, v): the rows of packed codes and numbers."""

    def run(batches):
        for batch in batches:
            for codes, numbers in zip(batch.column(2), batch.column(3)):
                g, v = unsqueezed(codes.as_buffer()), unsqueezed(numbers.as_buffer(), number)
                for at in range(0, len(g), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(g[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], names=["g", "v"])

    return df.mapInArrow(run, "g long, v long")


def answered(ready: DataFrame, text: str, shards: int, table: DataFrame, questions: DataFrame, codes_of: Callable, add: Callable, schema: T.StructType, solve: Callable | None = None, shard: Callable = shard_of, number=np.int64) -> DataFrame:
    """add(rows, parts) for each block of ready (with the column _block and packed texts): parts has, for each batch of its texts, what codes_of gave with its codes, and the codes' values.

    Values are doubles: a shard's numbers in table (packed), or solve(codes, numbers) of all its rows by rising code."""

    def answer(batches):
        at, parts, g, v = None, [], None, None
        for batch in batches:
            out = []
            for s, block, codes, numbers in zip(*(batch.column(i) for i in range(4))):
                if s.as_py() != at:
                    at, parts, g, v = s.as_py(), [], None, None
                codes = unsqueezed(codes.as_buffer())
                if block.as_py() < 0:
                    parts.append((codes, unsqueezed(numbers.as_buffer(), number)))
                    continue
                if g is None:
                    g, v = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                    parts = []
                    order = np.argsort(g, kind="stable")
                    g, v = g[order], v[order]
                    v = solve(g, v) if solve else v
                out.append((block.as_py(), at, len(codes), squeezed_doubles(v[np.searchsorted(g, codes)])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "shard", "size", "numbers"])
        release()

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        places = Places(int(np.sum(answers.column("size").to_numpy())))
        parts = []
        for b in unpacked(group.select([text]).to_batches(), text):
            codes, more, *_ = codes_of(b)
            parts.append((more, places(codes)))
        codes, at = places.met()
        order, _ = by_shard(codes, shards, shard)
        values = np.zeros(len(places.bag.code))
        answers = answers.take(pa.array(np.argsort(answers.column("shard").to_numpy())))
        values[at[order]] = np.concatenate([np.zeros(0), *(unsqueezed_doubles(raw) for raw in answers.column("numbers").to_pylist())])
        del places, codes, at, order
        out = add(group, ((more, values[p]) for more, p in parts))
        release()
        return out

    plain = questions.select("shard", "block", "codes", F.lit(None).cast("binary").alias("numbers"))
    met = table.unionAll(plain).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    answers = met.mapInArrow(answer, "block int, shard int, size long, numbers binary")
    return ready.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
