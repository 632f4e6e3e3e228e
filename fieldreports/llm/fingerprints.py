"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed with a rolling polynomial; of every
``w`` neighbouring hashes the smallest is chosen, the rightmost one on ties, and
kept with its position.  Any match of at least ``w + k - 1`` code points of two
texts then shares a chosen hash; matches shorter than ``k`` are never seen.

Defined results: a null text counts as empty and has no hashes; a text shorter
than ``k`` has one hash, that of its whole text, at 0; two empty fingerprints
are alike by 1.0, an empty and a full one by 0.0.  Rows with one ``doc_id`` are
neighbours in the order of their texts, and null ids come last; a very long text is read whole, in one task;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldreports.llm.common import mix64, ship

GRAM = 16
WINDOW = 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(max(n, 1 << 16), np.uint64(base))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of every run of k code points; of the whole text where it is shorter."""
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    up, down = _power_tables(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    n = len(points) - k + 1
    return mix64((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))


def winnow(points: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` of the chosen grams, by position.

    The minimum of w neighbours comes from doubling: that of 2, 4, ... ones,
    and two overlapping runs for the rest.
    """
    h = gram_hashes(points, k)
    if not len(h):
        return h, np.zeros(0, np.int64)
    w = min(w, len(h))
    low, at, size = h, np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        right = low[step:] <= low[:-step]
        low = np.where(right, low[step:], low[:-step])
        at = np.where(right, at[step:], at[:-step])
        size += step
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    at = at[first]
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Hex text of the fingerprint: four bytes of each hash and its position."""
    out = np.empty((len(hashes), 2), ">u4")
    out[:, 0] = hashes >> np.uint64(32)
    out[:, 1] = positions
    return out.tobytes().hex()


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, hashes array<bigint>, positions array<bigint>`` of every document (no shuffle)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [winnow(code_points(t), k, w) for t in batch.column(1).to_pylist()]
            cols = [[f[i].astype(np.int64) for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], names=["doc_id", "hashes", "positions"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, hashes array<bigint>, positions array<bigint>")


# ---------------------------------------------------------------- neighbours

_NO_ID = -(2**63)


def in_descending_order(docs: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """``bucket, extra, doc_id, text``: the documents by descending id, dealt
    into id ranges and sorted in each.

    The bounds are ids that occur (an approximate quantile sketch of the id
    column), so the first document of every range is known beforehand; a copy
    of it (``extra``) ends the range before, and the first one's ends the last.
    Every document but an extra is thus followed by its neighbour in the same
    partition: one shuffle of the texts, no global window.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    keyed = docs.select("doc_id", F.col("text").cast("string"), key.alias("key"))
    n = keyed.count()
    if n == 0:
        return keyed.select(F.lit(0).alias("bucket"), F.lit(0).alias("extra"), "doc_id", "text")
    buckets = min(n, max(-(-n // rows_per_bucket), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / buckets for i in range(1, buckets)]
    row = keyed.agg(F.max("key").alias("top"), F.percentile_approx("key", shares, max(10_000, 4 * buckets)).alias("cuts")) if shares else keyed.agg(F.max("key").alias("top"))
    got = row.first()
    bounds = np.unique(np.array([got["top"], *(got["cuts"] if shares else [])], np.int64))  # ascending

    @F.pandas_udf("bucket int, head boolean")
    def place(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(bounds, keys.to_numpy(np.int64), side="left")  # the smallest bound that is not below
        return pd.DataFrame({"bucket": (len(bounds) - 1 - at).astype(np.int32), "head": bounds[at] == keys.to_numpy(np.int64)})

    last = len(bounds) - 1
    before = F.when(F.col("at.bucket") == 0, F.lit(last)).otherwise(F.col("at.bucket") - 1)
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(0).alias("extra"))
    copy = F.struct(before.alias("bucket"), F.lit(1).alias("extra"))
    dealt = keyed.withColumn("at", place("key")).select("doc_id", "text", "key", F.inline(F.when(F.col("at.head"), F.array(own, copy)).otherwise(F.array(own))))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), "text").select("bucket", "extra", "doc_id", "text")


def compare_with_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many of the next document in descending id order.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def row(doc_id, points, own, following, theirs):
        half = len(points) // 2
        edited = np.concatenate((points[: len(points) - half], following[:half]))
        found = winnow(edited, k, w)
        sha = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
        return doc_id, len(points), sha, digest(*own), digest(*found), likeness(own[0], found[0]), likeness(own[0], theirs[0])

    def run(batches):
        waiting = None
        for batch in batches:
            rows = []
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if extra and waiting is None:
                    continue
                points = code_points(text)
                own = winnow(points, k, w)
                if waiting is not None and waiting[0] == bucket:
                    rows.append(row(*waiting[1:], points, own))
                waiting = None if extra else (bucket, doc_id, points, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return in_descending_order(docs).mapInArrow(run, schema)
