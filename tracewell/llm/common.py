"""Pieces that the operators of this folder share: reading, checkpoints, and text as numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes; words are the runs between them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z only, byte by byte, so that UTF-8 sequences stay whole.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that a task works on at a time; arrays beside it are eight times as large.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


#: Rows and bytes of a batch between the JVM and Python, where the session has Spark's defaults: a batch of 10,000 rows holds some
#: 40 MB of usual texts four times over (twice on either side), and one of long texts far more.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Smaller batches for sessions that have not chosen; others keep theirs."""
    for key, usual, mine in (("spark.sql.execution.arrow.maxRecordsPerBatch", {"10000", None}, BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", {"64MB", "67108864b", "67108864", "256MB", "-1", None}, BATCH_BYTES)):
        if spark.conf.get(key, None) in usual:
            spark.conf.set(key, str(mine))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes a shuffle's files when the driver's JVM finds that nothing refers to it; the scheduler may refer to the last job's until another has run."""
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of checkpoints, or else in the warehouse (a cluster shares both): compressed, and read column by column."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: the folds that op2 and op4 hold out by."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _ODD), ("down", _ODD_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[:1] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash reads the hash of any span of buf."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    ends = np.cumsum(size)
    return buf[np.repeat(start - ends + size, size) + np.arange(ends[-1])] if len(size) else buf[:0]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its rows' offsets; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about size bytes of text, one whole row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, upto - at)
            at = upto
    release()


def release() -> None:
    """Gives freed memory back at a task's end; a worker that is used again would hold it beside what comes next."""
    if len(_powers.get("up", ())) > 4 * CHUNK:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words of all rows."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.r_[True, space[:-1]] | edge[:-1]
    after = np.r_[space[1:], True] | edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def byte_words(text: bytes | str | None) -> list[bytes]:
    """The words of one text, A-Z lower-cased: bytes.split() parts at ASCII white space only."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and edges a-b, each node's smallest reachable node: hooking and pointer jumping, as arrays."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def small_table(df: DataFrame, most: int) -> list | None:
    """df's rows if there are at most `most` of them, else None: the check before anything is broadcast."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
