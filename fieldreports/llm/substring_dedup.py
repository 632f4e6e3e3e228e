"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document; words covered by a
window whose word sequence also starts anywhere else are removed.

Reference blocks of ``BLOCK`` words lie side by side in every document.  As
``2 * BLOCK - 1 <= WINDOW``, a window always holds one whole block, so where two
windows are equal, each meets the other's block as one of its own rolling block
windows.  The steps:

1. every rolling window of ``BLOCK`` words probes the reference blocks: tasks
   send short keys of their windows, packed by bucket of the key, and each bucket
   answers which windows meet a block that is somewhere else;
2. hits are extended: every window of ``WINDOW`` words that holds a hit is sent
   by two independent 64-bit hashes, and those that agree in both and occur twice
   are repeats; neighbouring ones join to the maximal exact repeats.

A task that sees a window twice itself marks its places at once and sends only
one of them, so copies in one file and hot passages add little to the shuffle.
A short key that agrees by chance only adds a window to step 2.  A bucket gets a
bounded number of windows, as there are more buckets for more words; windows of
one hot passage or of many copies have different hashes and spread over the
buckets, and no pair of occurrences is ever formed.

Defined results: a null text counts as empty; equal rows get equal results, and
as each is elsewhere for the other, all their windows go.  An empty table gives
an empty table; a very long text is read whole, in one task.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldreports.llm.common import Words, chunks, discard, mix64, release, ship, store, string_buffers, windows

WINDOW = 35
BLOCK = 18
UNIT_WORDS = 1_500_000
BUCKET_CHARS = 6_000_000

_SENT = "bucket int, unit long, keys binary, low binary, high binary, row1 binary, row2 binary, words binary"
_ANSWER = "unit long, found binary, row1 binary, row2 binary, words binary"


#: The full key of a window: two independent hashes of its words.
_FULL_KEY = np.dtype([("one", np.uint64), ("two", np.uint64)])


def _full_keys(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    keys = np.empty(len(one), _FULL_KEY)
    keys["one"], keys["two"] = one, two
    return keys


def _order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable") if keys.dtype.names is None else np.lexsort((keys["two"], keys["one"]))


def _first_of_group(keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys of a sorted array begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _packed(unit: int, buckets: int, hashes, at, flags, short: bool):
    """Rows of one unit: its windows by bucket, as planes that compress well."""
    bucket = ((hashes if short else hashes["one"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, at, flags = bucket[order], hashes[order], at[order].astype(np.uint32), flags[order]
    if short:
        keys = ((hashes >> np.uint64(33)).astype(np.uint32) << np.uint32(1)) | flags.astype(np.uint32)
    else:
        keys = hashes
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    low, high = at.astype(np.uint16), (at >> np.uint32(16)).astype(np.uint16)
    for i, j in zip(edges, [*edges[1:], len(bucket)]):
        yield int(bucket[i]), unit, keys[i:j].tobytes(), low[i:j].tobytes(), high[i:j].tobytes(), None, None, None


def _found_here(hashes: np.ndarray, at: np.ndarray, flags: np.ndarray):
    """Places of windows that a unit settles itself, and what is left to send:
    of windows that occur twice, one of them flagged, a flagged one is sent."""
    order = _order(hashes)
    new = _first_of_group(hashes[order])
    size = np.diff(np.append(new, len(order)))
    settled = (size > 1) & np.logical_or.reduceat(flags[order], new) if len(new) else np.zeros(0, bool)
    places = at[order][np.repeat(settled, size)]
    send = np.repeat(~settled, size)
    send[new] = True
    flags = flags.copy()
    flags[order[new[settled]]] = True
    kept = np.sort(order[send])
    return places.astype(np.uint32), hashes[kept], at[kept], flags[kept]


def _record(rows, schema: str, types):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split(" ")[0] for c in schema.split(", ")])


_SENT_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
_ANSWER_TYPES = [pa.int64(), *[pa.binary()] * 4]


def _block_windows(words: Words, _):
    hashes, at = windows(words.hash, words.first, BLOCK)
    place = at - words.first[np.searchsorted(words.first, at, side="right") - 1]
    return hashes, at, place % BLOCK == 0


def _full_windows(words: Words, hits: list[bytes]):
    """Windows that hold a hit: two block windows, 17 words apart, name one, by
    two hashes each."""
    one, at = windows(words.hash, words.first, BLOCK)
    two, _ = windows(words.second_hash, words.first, BLOCK)
    n = len(words.hash)
    by_place = np.zeros((2, n + 1), np.uint64)
    valid = np.zeros(n + 1, bool)
    by_place[0, at], by_place[1, at], valid[at] = one, two, True
    change = np.zeros(n + 1, np.int32)
    for d, found in enumerate(hits):
        base = words.first[d]
        starts = np.frombuffer(found, np.uint32).astype(np.int64)
        np.add.at(change, base + np.maximum(starts - (WINDOW - BLOCK), 0), 1)
        np.add.at(change, base + starts + 1, -1)
    step = WINDOW - BLOCK
    q = np.flatnonzero((np.cumsum(change) > 0)[: n - step] & valid[: n - step] & valid[step:n]) if n > step else np.zeros(0, np.int64)
    # valid block windows 17 apart lie in one text only if the text goes on
    text = np.searchsorted(words.first, q, side="right") - 1
    q = q[q + WINDOW <= words.first[text + 1]]
    full = mix64(by_place[:, q] * np.uint64(0x9E3779B97F4A7C15) + by_place[:, q + step])
    return _full_keys(*full), q, np.ones(len(q), bool)


def _occurring_twice(rows: DataFrame, buckets: int, choose, short: bool) -> DataFrame:
    """``row1, row2, found``: for each row the places (words) of its chosen
    windows whose key occurs elsewhere (with a flagged occurrence among them).

    ``rows`` has ``row1, row2`` (two hashes that name a row's content), ``text``
    and ``hits``.
    """

    def send(batches):
        part = TaskContext.get().partitionId()
        unit = part << 32
        waiting, base = [], 0

        def flush():
            nonlocal unit, waiting, base
            if not waiting:
                return
            hashes, at, flags, row1, row2, n = (np.concatenate([w[i] for w in waiting]) for i in range(6))
            places, hashes, at, flags = _found_here(hashes, at, flags)
            out = list(_packed(unit, buckets, hashes, at, flags, short))
            out.append((unit % buckets, unit, None, places.tobytes(), None, row1.tobytes(), row2.tobytes(), n.astype(np.uint32).tobytes()))
            unit, waiting, base = unit + 1, [], 0
            for i in range(0, len(out), 256):
                yield _record(out[i : i + 256], _SENT, _SENT_TYPES)

        for batch in batches:
            raw, offsets = string_buffers(batch.column(2))
            row1, row2 = (batch.column(i).to_numpy() for i in (0, 1))
            hits = batch.column(3).to_pylist()
            for i, j in chunks(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes, at, flags = choose(words, hits[i:j])
                waiting.append((hashes, at + base, flags, row1[i:j], row2[i:j], words.counts))
                base += len(words.hash)
                if base >= UNIT_WORDS:
                    yield from flush()
        yield from flush()

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        full = [r for r in rows if r["keys"] is not None]
        out = [(r["unit"], r["low"], r["row1"], r["row2"], r["words"]) for r in rows if r["keys"] is None]
        if full:
            keys = np.frombuffer(b"".join(r["keys"] for r in full), np.uint32 if short else _FULL_KEY)
            flags = (keys & keys.dtype.type(1)).astype(bool) if short else np.ones(len(keys), bool)
            keys = keys >> np.uint32(1) if short else keys
            order = _order(keys)
            new = _first_of_group(keys[order])
            size = np.diff(np.append(new, len(keys)))
            good = (size > 1) & np.logical_or.reduceat(flags[order], new)
            hit = np.zeros(len(keys), bool)
            hit[order] = np.repeat(good, size)
            at = 0
            for r in full:
                n = len(r["low"]) // 2
                mine = hit[at : at + n]
                if mine.any():
                    place = np.frombuffer(r["low"], np.uint16).astype(np.uint32) | (np.frombuffer(r["high"], np.uint16).astype(np.uint32) << np.uint32(16))
                    out.append((r["unit"], place[mine].tobytes(), None, None, None))
                at += n
        names = [c.split(" ")[0] for c in _ANSWER.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER_TYPES)], names=names) if out else pa.Table.from_arrays([pa.array([], t) for t in _ANSWER_TYPES], names=names)

    def by_row(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        held = next((r for r in rows if r["words"] is not None), None)
        found = [np.frombuffer(r["found"], np.uint32) for r in rows if r["found"] is not None]
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["row1", "row2", "found"])
        if held is None or not any(map(len, found)):
            return empty
        places = np.unique(np.concatenate(found)).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(np.frombuffer(held["words"], np.uint32), dtype=np.int64)))
        cut = np.searchsorted(places, first)
        some = np.flatnonzero(np.diff(cut))
        row1, row2 = (np.frombuffer(held[k], np.int64)[some] for k in ("row1", "row2"))
        parts = [(places[cut[d] : cut[d + 1]] - first[d]).astype(np.uint32).tobytes() for d in some]
        return pa.Table.from_arrays([pa.array(row1), pa.array(row2), pa.array(parts, pa.binary())], names=["row1", "row2", "found"])

    sent = rows.select("row1", "row2", "text", "hits").mapInArrow(send, _SENT)
    answers = store(sent.groupBy("bucket").applyInArrow(answer, _ANSWER), "answers")
    found = store(answers.groupBy("unit").applyInArrow(by_row, "row1 long, row2 long, found binary").dropDuplicates(["row1", "row2"]), "found")
    discard(answers)
    release(rows.sparkSession)
    return found


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every document;
    ``kept`` is the text that is left, its words joined by single spaces, and
    null where nothing was removed."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns(
        {"row1": F.xxhash64("doc_id", "text"), "row2": F.xxhash64("text", "doc_id", F.lit(7)), "hits": F.lit(None).cast("binary")}
    )
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET_CHARS)

    hits = _occurring_twice(rows, buckets, _block_windows, True)

    id_type = docs.schema["doc_id"].dataType
    done = f"doc_id {id_type.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept string"
    done_types = [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def split(batches):
        names = [c.split(" ")[0] for c in f"{done}, row1 long, row2 long, text string, hits binary".split(", ")]
        for batch in batches:
            out = []
            for doc_id, text, row1, row2, found in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                if found is None or len(words) < WINDOW:
                    out.append((doc_id, len(words), 0, _digest(words), None, None, None, None, None))
                else:
                    out.append((doc_id, len(words), None, None, None, row1, row2, text, found))
            yield _record(out, ", ".join(f"{n} x" for n in names), [*done_types, pa.int64(), pa.int64(), pa.string(), pa.binary()])

    joined = rows.drop("hits").join(hits.withColumnRenamed("found", "hits"), ["row1", "row2"], "left").select("doc_id", "text", "row1", "row2", "hits")
    halfway = store(joined.mapInArrow(split, f"{done}, row1 long, row2 long, text string, hits binary"), "halfway")
    discard(hits)
    release(spark)

    pending = halfway.where(F.col("n_removed").isNull()).select("doc_id", "row1", "row2", "text", "hits")
    repeats = _occurring_twice(pending, buckets, _full_windows, False)

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int32)
                if found is not None:
                    starts = np.frombuffer(found, np.uint32)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + WINDOW, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = [w for w, g in zip(words, gone.tolist()) if not g]
                n = int(gone.sum())
                out.append((doc_id, len(words), n, _digest(left), b" ".join(left).decode() if n else None))
            yield _record(out, done, done_types)

    ended = pending.join(repeats, ["row1", "row2"], "left").select("doc_id", "text", "found").mapInArrow(cut, done)
    return halfway.where(F.col("n_removed").isNotNull()).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").unionByName(ended)
