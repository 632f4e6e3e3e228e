"""Best-fit packing: documents into sequences of a fixed number of tokens.

Pattern packing by non-negative least squares: patterns of a few lengths that
fill a sequence are enumerated, repeat counts are fitted to the histogram of
lengths, rounded down, and what is left is packed best fit, again as patterns
of lengths.  Only the histogram (at most ``capacity`` numbers) and the plan
reach the driver; pieces get their rank among pieces of one length by counts of
salted groups, and the plan maps (length, rank) to a sequence and an offset.

Defined results: a null text counts as empty and is one piece, the end id
alone; an empty table gives no piece; repeated rows are packed one by one;
a very long text is read whole, in one task, and cut into pieces.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldreports.llm.common import ship, store

CAPACITY = 2048
END_ID = 0

_encoders: dict[str, object] = {}


def encoder(path: str | None = None):
    """The tokenizer whose ranks are in the file ``path`` (kept per process).

    The ranks file and ``byte_bpe_50k.json`` hold one vocabulary; see :func:`tokenize`.
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def tokenize(path: str | None = None):
    """A function of a text that gives the ids of ``byte_bpe_50k.json`` by the
    ``tokenizers`` library (added tokens as their own ids).

    ``tiktoken`` gives the same ids in a third of the time, except where a text
    holds an added token or where its regular expression runs out of stack (about
    a million white-space characters in a row); those texts go to ``tokenizers``.
    With a ranks file of one's own (``path``) there are no added tokens.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    fast = encoder(path).encode_to_numpy
    if path is not None:
        return lambda text: fast(text, disallowed_special=())
    if "whole" not in _encoders:
        _encoders["whole"] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = _encoders["whole"]
    added = [token.content for token in whole.get_added_tokens_decoder().values()]

    def ids(text: str):
        if not any(token in text for token in added):
            try:
                return fast(text, disallowed_special=())
            except ValueError:  # the regular expression gave up
                pass
        return whole.encode(text, add_special_tokens=False).ids

    return ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document (no shuffle)."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    arrow = [to_arrow_type(id_type), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encode = tokenize(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = encode(text) if text else ()
                ids = np.empty(len(got) + 1, "<u4")
                ids[:-1], ids[-1] = got, END_ID
                start, end = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end = end, end + capacity
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan


def few_document_patterns(counts: np.ndarray, capacity: int, thirds: int = 12) -> np.ndarray:
    """Patterns of one to three lengths that fill a sequence to the last token.

    ``counts[l]`` is the number of pieces of length l.  Rows are lengths in
    descending order, 0 where a pattern has fewer.
    """
    present = np.flatnonzero(counts)
    present = present[present > 0]
    some = counts > 0
    out = [np.array([[capacity, 0, 0]])] if some[capacity] else []
    if len(present) == 0:
        return np.zeros((0, 3), np.int64)
    a = present[(present >= capacity / 2) & (present < capacity)]
    pair = a[some[capacity - a]]
    out.append(np.column_stack((pair, capacity - pair, np.zeros_like(pair))))
    # for the third length: the most frequent short ones, ties by length
    by_count = present[np.lexsort((present, -counts[present]))]
    for c in by_count[: thirds * 4]:
        b = present[(present >= c) & (present < capacity - c)]
        a = capacity - c - b
        ok = (a >= b) & some[np.clip(a, 0, capacity)]
        out.append(np.column_stack((a[ok], b[ok], np.full(ok.sum(), c))))
    return np.unique(np.concatenate(out), axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x that bring the pieces which the
    patterns use closest to the histogram (accelerated projected gradient)."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    h = counts.astype(np.float64)

    def pieces_of(x):
        made = np.bincount(patterns.ravel(), (x[:, None] * used).ravel(), len(h))
        made[0] = 0
        return made

    # the largest eigenvalue of A'A, by a few power steps
    v = np.ones(len(patterns))
    norm = 1.0
    for _ in range(20):
        v = (pieces_of(v)[patterns] * used).sum(1)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 1.0 / (1.1 * norm)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(steps):
        grad = ((pieces_of(y) - h)[patterns] * used).sum(1)
        new = np.maximum(y - step * grad, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` that together use every piece of the histogram once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], repeats: int) -> None:
        if repeats > 0:
            out.append((lengths, repeats))
            for length in lengths:
                left[length] -= repeats

    def most(lengths: tuple[int, ...]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in lengths)

    patterns = few_document_patterns(counts, capacity)
    repeats = np.floor(fit_repeats(patterns, counts) + 1e-9).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] > 0:
            lengths = tuple(int(x) for x in patterns[i] if x)
            use(lengths, min(int(repeats[i]), most(lengths)))
    # the rest: the longest piece first, then again and again the longest that
    # fits; every such pattern is used as often as it can be, which uses up a length
    while True:
        present = np.flatnonzero(left > 0)
        if not len(present):
            return out
        lengths, room, have = [], capacity, {}
        while True:
            i = int(np.searchsorted(present, room, side="right")) - 1
            while i >= 0 and have.get(present[i], 0) >= left[present[i]]:
                i -= 1
            if i < 0:
                break
            x = int(present[i])
            times = int(min(room // x, left[x] - have.get(x, 0)))
            have[x] = have.get(x, 0) + times
            lengths += [x] * times
            room -= x * times
        shape = tuple(lengths)
        use(shape, min(int(left[x]) // n for x, n in have.items()))


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, rank): sorted ``key = length << 40 | first rank``,
    the sequence of that rank and the offset in it."""
    taken: dict[int, int] = {}
    key, sequence, offset = [], [], []
    base = 0
    for lengths, repeats in shapes:
        at = 0
        for x in lengths:
            rank = taken.get(x, 0)
            key.append((x << 40) | rank)
            sequence.append(base)
            offset.append(at)
            taken[x] = rank + repeats
            at += x
        base += repeats
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in (("key", key), ("sequence", sequence), ("offset", offset))}


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = store(pieces(docs, capacity, path), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))

    # rank of a piece among those of its length, without a group of a whole
    # length: groups of one length and salt are a fraction of a partition each
    share = max(1, int(counts.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.element_at(F.lit([int(-(-c // share)) or 1 for c in counts[1:]]), F.col("length").cast("int"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts.cast("long")))
    group = Window.partitionBy("length", "salt")
    before = (
        salted.groupBy("length", "salt").count()
        .select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(group.orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    )

    def run(batches):
        p = places.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            i = np.searchsorted(p["key"], (length << 40) | rank, side="right") - 1
            sequence = p["sequence"][i] + (rank - (p["key"][i] & ((1 << 40) - 1)))
            cols = [*batch.columns[:5], pa.array(sequence), pa.array(p["offset"][i])]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
