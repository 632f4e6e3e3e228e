"""Character models as tables: counts of grams, values of grams, sums over texts.

A gram is ``order`` symbols of ``bits`` bits each in one 64-bit number, the newest
symbol lowest.  A model has several columns (languages, or the two sides of a
ratio).  Its counts of all orders and contexts are a stored table, keyed by
(kind, gram); nothing of it is gathered in one place, however large it grows:

* :func:`model_table` derives the lower orders and the contexts by aggregation;
* :func:`values` joins any grams with what the model holds on them and their
  contexts, and puts the parts together in numpy, batch by batch;
* :func:`sums` adds the values of all grams of each text.  The most frequent grams
  are sent to the tasks with their values, at most ``HEAD_CELLS`` numbers whatever
  the corpus; the occurrences of all others are joined with their values.

Values are fixed-point integers (``SCALE`` a unit), so sums do not depend on the
order of additions, nor on which grams were sent: equal texts have equal sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.llm.common import chunks, store, string_buffers

SCALE = 1 << 20
#: Values that are sent to every task at most (4 bytes each, and 8 bytes a gram).
HEAD_CELLS = 8_000_000
_BINS = 8  # of the totals, per doubling
_DENSE_CELLS = 200_000


@dataclass(frozen=True)
class Shape:
    """Symbols of a gram, bits of a symbol, columns of the model."""

    order: int
    bits: int
    columns: int

    def mask(self, k: int) -> int:
        """The lowest k symbols."""
        return (1 << (self.bits * k)) - 1 if self.bits * k < 64 else -1


def _suffix(gram: Column, shape: Shape, k: int) -> Column:
    return gram.bitwiseAND(F.lit(shape.mask(k)).cast("long")) if k < shape.order else gram


def level_table(counts: DataFrame, shape: Shape, continuation: bool) -> DataFrame:
    """``kind, key, col, n``: the grams of every order (``kind``) with their counts.

    ``counts`` has ``col, gram, n``.  Orders below the highest count occurrences or,
    with ``continuation``, the different symbols seen before a gram."""
    gram = F.col("gram")
    levels = [counts.select(F.lit(shape.order).alias("kind"), gram.alias("key"), "col", "n")]
    for k in range(shape.order - 1, 0, -1):
        if continuation:
            above = counts.select("col", _suffix(gram, shape, k + 1).alias("gram"))
            above = (above if k + 1 == shape.order else above.distinct()).withColumn("n", F.lit(1))
        else:
            above = counts
        level = above.groupBy("col", _suffix(gram, shape, k).alias("key")).agg(F.sum("n").alias("n"))
        levels.append(level.select(F.lit(k).alias("kind"), "key", "col", "n"))
    return reduce(DataFrame.unionByName, levels)


def model_table(levels: DataFrame, shape: Shape) -> DataFrame:
    """``kind, key, entries (col, a, b)``: for a gram of order ``kind`` its count a;
    for a context (``-kind``, the gram without its last symbol) the total a of what
    follows and the number b of different symbols that do."""
    context = F.shiftrightunsigned("key", shape.bits) if shape.order > 1 else F.lit(0).cast("long")
    contexts = levels.groupBy((-F.col("kind")).alias("kind"), context.alias("key"), "col").agg(F.sum("n").cast("double").alias("a"), F.count("*").cast("double").alias("b"))
    grams = levels.select("kind", "key", "col", F.col("n").cast("double").alias("a"), F.lit(0.0).alias("b"))
    return grams.unionByName(contexts).groupBy("kind", "key").agg(F.collect_list(F.struct("col", "a", "b")).alias("entries"))


def roots(model: DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Total and kinds of the empty context, by column."""
    total, kinds = np.zeros(shape.columns), np.zeros(shape.columns)
    for r in model.where("kind = -1").select(F.inline("entries")).collect():  # one row a column
        total[r["col"]], kinds[r["col"]] = r["a"], r["b"]
    return total, kinds


#: ``combine(grams, contexts)`` gives a row of values for each gram; ``grams[k]`` are
#: counts (grams x columns) of its last k symbols, ``contexts[k]`` totals and kinds.
Combine = Callable[[dict, dict], np.ndarray]


def _value_batches(batches, shape: Shape, root: tuple[np.ndarray, np.ndarray], combine: Combine):
    step = max(1, _DENSE_CELLS // shape.columns)
    for whole in batches:
        for begin in range(0, whole.num_rows, step):
            batch = whole.slice(begin, step)
            n = batch.num_rows
            slots = np.zeros((2, 2 * shape.order + 1, n, shape.columns))
            found = batch.column(1)
            gram_of = pc.list_parent_indices(found).to_numpy()
            kind, entries = found.flatten().flatten()
            part = pc.list_parent_indices(entries).to_numpy()
            col, a, b = (x.to_numpy(zero_copy_only=False) for x in entries.flatten().flatten())
            at = (kind.to_numpy(zero_copy_only=False)[part] + shape.order, gram_of[part], col)
            slots[0][at], slots[1][at] = a, b
            grams = {k: slots[0, shape.order + k] for k in range(1, shape.order + 1)}
            contexts = {k: (slots[0, shape.order - k], slots[1, shape.order - k]) for k in range(2, shape.order + 1)}
            contexts[1] = tuple(np.broadcast_to(x, (n, shape.columns)) for x in root)
            out = np.rint(np.clip(combine(grams, contexts), -1000, 1000) * SCALE).astype(np.int32)
            width = out.shape[1]
            logs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), logs], names=["gram", "logs"])


def values(grams: DataFrame, model: DataFrame, shape: Shape, root: tuple[np.ndarray, np.ndarray], combine: Combine) -> DataFrame:
    """``gram, logs array<int>`` of the distinct grams in ``grams`` (column ``gram``),
    whether the model holds them or not."""
    wanted = []
    for k in range(1, shape.order + 1):
        key = _suffix(F.col("gram"), shape, k)
        wanted.append(F.struct(F.lit(k).alias("kind"), key.alias("key")))
        if k > 1:
            wanted.append(F.struct(F.lit(-k).alias("kind"), F.shiftrightunsigned(key, shape.bits).alias("key")))
    asked = grams.select("gram", F.explode(F.array(*wanted)).alias("w")).select("gram", "w.kind", "w.key")
    parts = asked.join(model, ["kind", "key"], "left").groupBy("gram").agg(F.collect_list(F.struct("kind", "entries")).alias("found"))
    return parts.mapInArrow(lambda b: _value_batches(b, shape, root, combine), "gram long, logs array<int>")


@dataclass
class Head:
    """Sorted grams and their values."""

    keys: np.ndarray
    logs: np.ndarray


def frequent(counts: DataFrame, shape: Shape) -> DataFrame:
    """The ``gram`` column of the most frequent grams of ``counts``: as many whole
    bins of totals as ``HEAD_CELLS`` values hold (all of a small corpus)."""
    totals = counts.groupBy("gram").agg(F.floor(F.log2(F.sum("n")) * _BINS).cast("int").alias("bin"))
    bins = sorted(((r["bin"], r["count"]) for r in totals.groupBy("bin").count().collect()), reverse=True)  # at most 64 * _BINS rows
    least, room = None, HEAD_CELLS // shape.columns
    for b, n in bins:
        room -= n
        if room < 0:
            break
        least = b
    return totals.where(F.lit(False) if least is None else F.col("bin") >= least).select("gram")


def head_of(frame: DataFrame, width: int) -> Head:
    """Gather the values of :func:`frequent` grams (bounded by ``HEAD_CELLS``)."""
    table = frame.toArrow().combine_chunks()
    if not table.num_rows:
        return Head(np.zeros(0, np.uint64), np.zeros((0, width), np.int32))
    keys = table.column("gram").to_numpy().view(np.uint64)
    logs = pc.list_flatten(table.column("logs")).to_numpy().reshape(-1, width)
    by = np.argsort(keys)
    return Head(keys[by], logs[by])


def _lists(lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sum_batches(batches, grams_of, head: Head):
    """Adds ``chars, sums, rest_gram, rest_n`` to batches whose first column is the text."""
    width = head.logs.shape[1]
    for batch in batches:
        raw, offsets = string_buffers(batch.column(0))
        n = len(offsets) - 1
        chars, sums = np.zeros(n, np.int64), np.zeros((n, width), np.int64)
        lengths, rest_gram, rest_n = np.zeros(n, np.int64), [], []
        for i, j in chunks(offsets):
            if offsets[i] == offsets[j]:
                continue
            packed, counts = grams_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            chars[i:j] = counts
            if not len(packed):
                continue
            kinds, at = np.unique(packed, return_inverse=True)
            place = np.searchsorted(head.keys, kinds)
            hit = np.zeros(len(kinds), bool)
            inside = place < len(head.keys)
            hit[inside] = head.keys[place[inside]] == kinds[inside]
            some = np.flatnonzero(counts)
            begins = (np.cumsum(counts) - counts)[some]
            for k in range(width):
                known = np.zeros(len(kinds), np.int64)
                known[hit] = head.logs[place[hit], k]
                sums[i + some, k] = np.add.reduceat(known[at], begins)
            left = np.flatnonzero(~hit[at])
            text = np.repeat(np.arange(j - i), counts)[left]
            pair, times = np.unique(text * len(kinds) + at[left], return_counts=True)
            lengths[i:j] = np.bincount(pair // len(kinds), minlength=j - i)
            rest_gram.append(kinds[pair % len(kinds)].view(np.int64))
            rest_n.append(times.astype(np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rest_gram, rest_n)]
        more = [pa.array(chars), _lists(np.full(n, width), sums.reshape(-1)), *(_lists(lengths, x) for x in flat)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=[*batch.schema.names[1:], "chars", "sums", "rest_gram", "rest_n"])


def sums(texts: DataFrame, text: str, grams_of, head, width: int, values_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(table, stored)``: the other columns of ``texts`` with ``chars``, the number of
    grams of the text, and ``sums array<long>``, their values summed; and the stored
    step that the table reads.  ``head`` is a broadcast :class:`Head`."""
    others = [c for c in texts.columns if c != text]
    kept = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in others)
    schema = f"{kept}chars long, sums array<long>, rest_gram array<long>, rest_n array<long>"
    found = texts.select(F.col(text).cast("string"), *others).mapInArrow(lambda b: _sum_batches(b, grams_of, head.value), schema)
    found = store(found.withColumn("text_row", F.monotonically_increasing_id()), "gram-sums")
    rest = found.select("text_row", F.explode(F.arrays_zip("rest_gram", "rest_n")).alias("r")).select("text_row", F.col("r.rest_gram").alias("gram"), F.col("r.rest_n").alias("times"))
    added = (
        rest.join(values_of(rest.select("gram").distinct()), "gram")
        .groupBy("text_row")
        .agg(F.array(*[F.sum(F.col("times") * F.col("logs")[k]) for k in range(width)]).alias("added"))
    )
    total = F.when(F.col("added").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "added", lambda a, b: a + b))
    return found.join(added, "text_row", "left").select(*others, "chars", total.alias("sums")), found
