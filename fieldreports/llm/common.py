"""Tables, scratch tables and batch helpers shared by the operators."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
import weakref
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldreports.session import scratch_path

#: Bytes of text that one numpy pass covers; the temporaries are about 50 times that.
CHUNK_BYTES = 2 << 20


_shipped: "weakref.WeakSet" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per context, so that
    Python tasks can import it wherever they run (what ``--py-files`` does)."""
    sc = spark.sparkContext
    if sc not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(tempfile.mkdtemp(prefix="pyfiles-"), os.path.basename(package))
        sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(sc)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir``, read by Spark's own reader."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*columns)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The table cuts the lineage, is shared by all executors and is what later
    steps read, so lost executors never make the work before it run again.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`store` wrote and that nothing will read again."""
    for df in frames:
        for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the cleaner remove shuffle files of frames that are no longer used
    (Spark drops them when the driver's collector finds them unreachable)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column: row i is ``bytes[offsets[i]:offsets[i+1]]``.

    No Python string is made.  A null has no bytes.
    """
    n = len(column)
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes, if a writer left any, are not text
        lengths = np.diff(offsets)
        if lengths[np.asarray(column.is_null())].any():
            return string_buffers(column.fill_null(""))
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges ``(i, j)`` of at most ``most`` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit words for a seed, the same on every machine."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: The separators of words, \x20 and \x09-\x0D.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True

_BYTE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed by a library function, one by one.
_MOST_CHUNKED = 64


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span ``raw[start:end]``.

    Eight bytes at a time go through a bijective mixer, so spans of one length up
    to eight bytes have different hashes, and what differs in longer ones cannot
    cancel out by the positions of its bytes, as it can in a sum.  Two seeds give
    two independent hashes."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, np.dtype("<u8"), buffer=padded, strides=(1,))
    lengths = ends - starts
    start, factor = seeded(41 + seed, 2)
    factor |= np.uint64(1)
    out = mix64((eight[starts] & _BYTE_MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * factor + start)
    more = np.flatnonzero((lengths > 8) & (lengths <= _MOST_CHUNKED))
    at = 8
    while len(more):
        out[more] = mix64(out[more] * factor + (eight[starts[more] + at] & _BYTE_MASKS[np.minimum(lengths[more] - at, 8)]))
        at += 8
        more = more[lengths[more] > at]
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(lengths > _MOST_CHUNKED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def span_ids(raw: np.ndarray, kept: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of byte spans, equal for equal spans and for no others.  The spans
    are the bytes ``raw[kept]``, cut into ``lengths``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.ascontiguousarray(raw[kept])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return spans.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts.

    ``starts`` and ``ends`` are byte positions in ``raw``, ``first[d]`` is the
    index of the first word of text d (``first[-1]``: their number), ``hash``
    one 64-bit hash per word, ``ids`` numbers that only equal words share.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        word = ~IS_SEPARATOR[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(raw), bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(len(raw), bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.raw, self.offsets, self.is_word_byte = raw, offsets, word

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends)

    @cached_property
    def second_hash(self) -> np.ndarray:
        """A hash of each word that is independent of ``hash``."""
        return span_hashes(self.raw, self.starts, self.ends, 1)

    @cached_property
    def ids(self) -> np.ndarray:
        return span_ids(self.raw, self.is_word_byte, self.ends - self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words inside one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for k, factor in enumerate(seeded(size, size) | np.uint64(1)):
        mixed += hashes[k : k + n] * factor
    ok = np.ones(len(hashes) + 1, bool)
    for f in first[1:-1] if len(first) < 64 else ():
        ok[max(0, f - size + 1) : f] = False
    if len(first) >= 64:
        ends = np.repeat(first[1:], np.diff(first))
        ok[: len(ends)] = np.arange(len(ends)) + size <= ends
    at = np.flatnonzero(ok[:n])
    return mix64(mixed[at]), at
