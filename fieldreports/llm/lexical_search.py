"""Ranked lexical search, reversed: the items are indexed, the documents stream by.

An inverted index over the items' terms goes to every task.  A task counts the
terms of each of its documents, adds their weights up for all items at once and
keeps the best documents of each item in a bounded heap; the heaps are merged, in
salted groups first, so no task reads one heap of every other task.

The index is the only thing that is broadcast.  Its size is known beforehand from
the items' texts: items are split by a hash into blocks of about ``BLOCK_BYTES``
of text, and the documents are streamed once for each block.

A pass over the documents before that counts what the weights need: the
documents with a term, all terms, and the documents that hold each indexed term;
its result has one row per indexed term.

Defined results: a null or empty text has no terms, so such a document is never
listed and such an item has no rows; very long texts are cut at term borders into
pieces of a megabyte while their terms are counted; equal scores go by ascending
doc_id, a null id last; repeated rows of ``docs`` are listed each; repeated items
(same id and text) count as one, items of one id with different texts are ranked
each for itself; an empty table on either side gives an empty table; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldreports.llm.common import ship

TOP = 10
#: Text of the items that one index holds.
BLOCK_BYTES = 16 << 20
#: Scores and postings that one numpy step covers.
STEP = 1 << 21
PIECE = 1 << 20
#: Groups in which the tasks' heaps are merged first.
MERGE_GROUPS = 64

# Term bytes are 0-9, a-z, A-Z (lowered) and all bytes beyond ASCII; the rest separates.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def term_counts(text: str | None) -> Counter:
    """The terms of a text, as UTF-8, with their occurrences."""
    raw, counts, at = (text or "").encode(), Counter(), 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            edge = _SEPARATOR.search(raw, end)
            end = edge.start() if edge else len(raw)
        counts.update(raw[at:end].translate(_TERM_BYTES).split())
        at = end
    return counts


class Index:
    """Inverted index over items' terms: term -> (item, occurrences in it)."""

    def __init__(self, texts: Iterable[str]):
        self.terms: dict[bytes, int] = {}
        rows = []
        for item, text in enumerate(texts):
            rows += [(self.terms.setdefault(t, len(self.terms)), item, n) for t, n in term_counts(text).items()]
        self.n_items = item + 1
        term, self.item, self.often = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 3
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which of the given terms, place in the postings)``."""
        degree = self.first[term + 1] - self.first[term]
        which = np.repeat(np.arange(len(term)), degree)
        before = np.cumsum(degree) - degree
        return which, np.arange(len(which)) - before[which] + self.first[term][which]


def _statistics(index: Index):
    """Per task: rows ``(term, n)``; term -1 stands for documents, -2 for all terms."""

    def run(batches):
        holding = np.zeros(len(index.terms), np.int64)
        documents = total = 0
        for batch in batches:
            for text in batch.column(0):
                counts = term_counts(text.as_py())
                documents += bool(counts)
                total += counts.total()
                held = [index.terms[t] for t in counts.keys() & index.terms.keys()]
                holding[held] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(holding[at], [documents, total]))], ["term", "n"])

    return run


def weights(holding: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in holding], np.int64)


def length_factor(n: int, documents: int, total: int) -> int:
    return 25 + (75 * n * documents) // total


class Heaps:
    """The best documents of every item: score descending, id ascending, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.zeros(n_items, np.int64)  # an item's last listed score, 0 while there is room

    def add(self, item, score, ids, null) -> None:
        """Rows with a score of at least the item's ``least``."""
        if not len(item):
            return
        item, score, ids, null = (np.concatenate(pair) for pair in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.top
        order = order[kept]
        self.item, self.score, self.id, self.null = item[kept], score[order], ids[order], null[order]
        count = np.bincount(self.item, minlength=len(self.least))
        full = np.flatnonzero(count >= self.top)
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def _search(index: Index, weight: np.ndarray, documents: int, total: int, top: int):
    def score(heaps: Heaps, rows: list, at: list, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of the documents in rows ``at`` of a batch; ``rows``: (place in ``at``, term, tf, m)."""
        if not at:
            return
        doc, term, tf, m = (np.array(c, np.int64) for c in zip(*rows))
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        which, place = index.postings(term)
        sums = np.zeros(len(at) * index.n_items, np.int64)
        np.add.at(sums, doc[which] * index.n_items + index.item[place], gain[which] * index.often[place])
        sums = sums.reshape(len(at), index.n_items)
        d, item = np.nonzero((sums > 0) & (sums >= heaps.least))
        row = np.array(at)[d]
        heaps.add(item, sums[d, item], ids[row], null[row])

    def run(batches):
        heaps = Heaps(index.n_items, top)
        degree = np.diff(index.first)
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            rows, at, size = [], [], 0
            for d, text in enumerate(batch.column(1)):
                counts = term_counts(text.as_py())
                held = counts.keys() & index.terms.keys()
                if not held:
                    continue
                m = length_factor(counts.total(), documents, total)
                own = [(len(at), index.terms[t], counts[t], m) for t in held]
                size += index.n_items + sum(int(degree[r[1]]) for r in own)
                rows += own
                at.append(d)
                if size > STEP:
                    score(heaps, rows, at, ids, null)
                    rows, at, size = [], [], 0
            score(heaps, rows, at, ids, null)
        yield pa.RecordBatch.from_arrays(
            [pa.array(heaps.item), pa.array(heaps.id, mask=heaps.null), pa.array(heaps.score)], ["item", "doc_id", "score"]
        )

    return run


def _best(heaps: DataFrame, top: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents (``doc_id``, ``text``)
    of every item (``item_id``, ``text``) with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    item_id = items.schema["item_id"].dataType
    long = T.LongType()
    none = spark.createDataFrame([], T.StructType().add("item_id", item_id).add("rank", T.IntegerType()).add("doc_id", long).add("score", long))
    found = none
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if not held:
            continue
        index = spark.sparkContext.broadcast(Index([r["text"] for r in held]))
        counted = texts.select("text").mapInArrow(_deferred(_statistics, index), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        counts = {r["term"]: r["n"] for r in counted}
        documents, total = counts.get(-1, 0), counts.get(-2, 0)
        if not documents:
            return none
        weight = weights(np.array([counts.get(t, 0) for t in range(len(index.value.terms))], np.int64), documents)
        heaps = texts.mapInArrow(_deferred(_search, index, weight, documents, total, top), "item long, doc_id long, score long")
        salted = heaps.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
        merged = _best(_best(salted, top, "item", "salt").drop("rank", "salt"), top, "item")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(held)], T.StructType().add("item", long).add("item_id", item_id))
        found = found.unionByName(merged.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return found


def _deferred(make, index, *args):
    """A task function that opens the broadcast index where it runs."""

    def run(batches):
        return make(index.value, *args)(batches)

    return run
