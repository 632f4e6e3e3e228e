"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (three bytes, and pairs of words), one
of target texts and one of all texts, give every document the weight ``p(text) / q(text)``; documents
are sampled without replacement in proportion to it by Gumbel top-k (the k
largest ``log weight + Gumbel noise``, noise seeded by ``doc_id``).

The target model is counted over at most ``most_rows`` labelled good documents
(the lowest seeded hashes), the raw model over all documents.  Unless k is
given, the sample has the share of the documents with words that the labels say
are of good quality.

Defined results: a null text, or one without words, has no weight and is never
sampled; equal texts have equal weights; rows with one ``doc_id`` and text have
equal keys, and ties at the end of the sample are taken in the order of
``doc_id``, of rows equal in both as many as are left; without target documents all weights are 0, without labels all documents with
words are sampled; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldreports.llm.common import Words, chunks, mix64, ship, store, string_buffers, windows

BUCKETS = 1 << 15
SMOOTHING = 1.0
RANKED = 100_000  # rows that are equal in key and tie and are ranked together
SEED = 9
BINS = 4096


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram, and the words of each text.

    Runs of three bytes have the first half of the buckets, word pairs the other."""
    words = Words(raw, offsets)
    pairs, at = windows(words.hash, words.first, 2)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = text[2:] == text[:-2]
    b = raw.astype(np.uint64)
    runs = mix64(b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16)))[same] if len(raw) > 2 else np.zeros(0, np.uint64)
    half = np.uint64(BUCKETS // 2)
    bucket = np.concatenate((runs % half, pairs % half + half)).astype(np.int64)
    return bucket, np.concatenate((text[2:][same], words.text_of[at])), words.counts


def _count(batches):
    """``bucket, n`` of a partition."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        raw, offsets = string_buffers(batch.column(0))
        for i, j in chunks(offsets):
            total += np.bincount(_grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over whole texts; BUCKETS numbers reach the driver."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of p / q for every bucket, both smoothed towards the raw counts' mean."""
    if not target.sum():
        return np.zeros(BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    p = (target + SMOOTHING * BUCKETS * q) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, log_weight`` of every document (no shuffle)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            weights, words = [np.zeros(0)], [np.zeros(0, np.int64)]
            for i, j in chunks(offsets):
                bucket, text, counts = _grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                weights.append(np.bincount(text, sent.value[bucket], j - i))
                words.append(counts)
            weight = pa.array(np.concatenate(weights), mask=np.concatenate(words) == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), weight], names=["doc_id", "log_weight"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, log_weight double")


def gumbel(doc_id, seed: int = SEED):
    """Standard Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """Adds ``kept``: the k rows of the largest keys (nulls never), ties by ``tie``.

    The k-th key is found by counting keys in bins, three times, each time inside
    the bin that holds it; only bin counts reach the driver.  In the last bin,
    whose width is the key range over ``BINS**3``, the different (key, tie) are
    counted and lined up; rows that share both are ranked in salted groups, so
    no task gets all rows of a hot id.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return rows.withColumn("kept", F.lit(False))
    above = 0
    for _ in range(3):
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        # rounding cannot turn the order of two keys round, so bins part the keys;
        # a bin's range is taken from its rows, as its computed borders are rounded
        bin_of = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)).cast("int")
        inside = rows.where(F.col(key).between(low, high)).groupBy(bin_of.alias("bin"))
        for r in sorted(inside.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect(), reverse=True):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        else:
            return rows.withColumn("kept", F.col(key).isNotNull())
    # the group of equal key and tie that the k-th row is in; groups, not rows, are lined up
    groups = rows.where(F.col(key).between(low, high)).groupBy(key, tie).agg(F.count(F.lit(1)).alias("n"))
    cut = groups.withColumn("to", F.sum("n").over(Window.orderBy(F.desc(key), tie))).where(F.col("to") >= k - above).orderBy("to").first()
    if cut is None:
        return rows.withColumn("kept", F.coalesce(F.col(key) >= low, F.lit(False)))
    take = k - above - (cut["to"] - cut["n"])
    at, known = F.lit(float(cut[key])), F.lit(cut[tie]).cast(rows.schema[tie].dataType)
    before = F.col(tie).isNull() | (F.col(tie) < known) if cut[tie] is not None else F.lit(False)
    here = F.coalesce((F.col(key) == at) & F.col(tie).eqNullSafe(known), F.lit(False))
    ahead = F.coalesce((F.col(key) > at) | ((F.col(key) == at) & before), F.lit(False))
    if take == cut["n"]:
        return rows.withColumn("kept", ahead | here)
    return rows.where(~here).withColumn("kept", ahead).unionByName(_some_of(rows.where(here), int(take), int(cut["n"])))


def _some_of(rows: DataFrame, take: int, n: int) -> DataFrame:
    """Adds ``kept``: ``take`` of ``n`` rows between which nothing chooses, ranked
    in groups of about ``RANKED`` rows by their place in the (stored) table."""
    salt = F.pmod(F.col("_row"), F.lit(-(-n // RANKED)))
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", salt)
    earlier = Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    lines = placed.groupBy("_salt").agg(F.count(F.lit(1)).alias("_n")).select("_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_salt").orderBy("_row"))
    return placed.withColumn("_rank", rank).join(lines, "_salt").select(*rows.columns, (F.col("_before") + F.col("_rank") <= take).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most_rows: int = 20_000, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, key, kept`` of every document."""
    judged = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    good = (
        judged.where("quality > 0 and toxic = 0")
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(most_rows)
        .select("doc_id")
    )
    target = docs.join(F.broadcast(good), "doc_id", "left_semi")  # at most most_rows numbers
    ratios = log_ratios(gram_counts(target), gram_counts(docs))
    scored = store(weigh(docs, ratios).withColumn("key", F.col("log_weight") + gumbel("doc_id", seed)), "weights")
    if k is None:
        share = judged.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
        k = round((1.0 if share is None else share) * scored.where("log_weight is not null").count())
    return top_k(scored, "key", k, "doc_id")
