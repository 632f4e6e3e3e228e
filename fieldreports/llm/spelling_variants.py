"""Spelling variant grouping: PartEnum signatures of letter multisets.

A word is a binary vector over (letter, occurrence): ``anna`` holds a1, a2, n1
and n2.  One inserted or deleted letter changes one entry, one replaced letter
two, so near words are within Hamming distance two.  The entries are partitioned
into ``FIRST`` x ``SECOND`` parts by a hash; of the first-level parts at least one
differs in at most ``k2 = ceil(3 / FIRST) - 1`` entries, and a signature is its
projection on ``SECOND - k2`` of its second-level parts, for each choice of them.
Two vectors within distance two share a signature, always.

Buckets of a signature are split without loss: one edit leaves either the first
half of the shorter word or the rest of it alone, so the join key is a signature
together with the length of the shorter word and that half.  Equal keys are
equi-joined and each pair is verified by its edit distance, so colliding hashes
only cost time.  Hot keys of the join are left to AQE's skew splitting.

Words are counted inside tasks before the shuffle.  A word's form has at least
ten times its count, so chains of forms are no longer than the decimal digits of
the largest count, and pointer doubling needs the logarithm of that many rounds.

Defined results: null and empty texts have no words; a null id counts as empty
text before the colon; a very long text is cut at run borders into pieces of a
megabyte, so its runs are whole; ties of the largest count go to the smallest
word in code-point order; every row counts, repeated rows too; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldreports.llm.common import discard, mix64, seeded, ship, store

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One of so many distinct runs of a document loses a code point.
ONE_IN = 31
#: A form has at least this many times the count of its variant.
FORM_TIMES = 10

#: PartEnum: the distance, and the parts of both levels.
DISTANCE = 2
FIRST = 1
SECOND = 3

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOT_RUN = re.compile("[^A-Za-zÀ-ÿ]")
PIECE = 1 << 20
#: Distinct words that a task counts before it hands them on.
MOST_COUNTED = 200_000

_LETTERS_LOWERED = bytes(c | 0x20 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def runs_of(text: str) -> Counter:
    """Every lower-cased run of a text, as UTF-8, with its occurrences."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            edge = NOT_RUN.search(text, end)
            end = edge.start() if edge else len(text)
        piece = text[at:end]
        if piece.isascii():
            counts.update(piece.encode().translate(_LETTERS_LOWERED).split())
        else:  # bytes.lower() lowers A-Z only
            counts.update(map(bytes.lower, map(str.encode, RUN.findall(piece))))
        at = end
    return counts


def results_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """``(word, occurrences)`` of a document, after its deletions; words of any length."""
    head = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in runs_of(text).items():
        h = zlib.crc32(run, head)
        word = run.decode()
        if h % ONE_IN == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def _count(batches):
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in results_of(doc_id, text.as_py() or ""):
                if len(word) >= LEAST_LENGTH:
                    counts[word] += n
            if len(counts) > MOST_COUNTED:
                yield rows()
                counts.clear()
    yield rows()


def words(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word."""
    counted = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def signatures(letters: np.ndarray, first: np.ndarray, parts: tuple[int, int] = (FIRST, SECOND)) -> np.ndarray:
    """PartEnum signatures, one row a word: word i has the code points
    ``letters[first[i]:first[i + 1]]`` (at least one)."""
    one, two = parts
    k2 = -(-(DISTANCE + 1) // one) - 1
    if not 0 <= k2 < two:
        raise ValueError("more second-level parts are needed")
    word_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((letters, word_of))
    sorted_letters = letters[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(sorted_letters) != 0) | (np.diff(word_of) != 0)
    starts = np.flatnonzero(new)
    occurrence = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    entry = mix64((sorted_letters.astype(np.uint64) << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))
    part = (entry % np.uint64(one * two)).astype(np.int64)
    code = mix64(entry + np.uint64(0x51_7CC1_B727))
    # a projection is a set of entries; the sum of their codes stands for it
    held = [np.add.reduceat(np.where(part == p, code, np.uint64(0)), first[:-1]) for p in range(one * two)]
    out = []
    for a in range(one):
        for chosen in itertools.combinations(range(two), two - k2):
            salts = seeded(101 + len(out), two)
            out.append(mix64(sum((mix64(held[a * two + b] + salts[b]) for b in chosen), np.zeros(len(first) - 1, np.uint64))))
    return np.stack(out, 1)


def _halves(letters: np.ndarray, first: np.ndarray, shorter: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first half and of the rest of a word whose near word is the
    shorter one, of length ``shorter``, or has that length too."""
    lengths = np.diff(first)
    at = np.arange(len(letters)) - np.repeat(first[:-1], lengths)
    from_end = np.repeat(lengths, lengths) - 1 - at
    half = np.repeat(shorter // 2, lengths)
    codes = mix64(letters.astype(np.uint64) + np.uint64(1))
    places = seeded(17, int(lengths.max(initial=1))) | np.uint64(1)
    head = np.add.reduceat(np.where(at < half, codes * places[at], np.uint64(0)), first[:-1])
    tail = np.add.reduceat(np.where(from_end < np.repeat(shorter, lengths) - half, codes * places[from_end], np.uint64(0)), first[:-1])
    return [mix64(head + np.uint64(3)), mix64(tail + np.uint64(5))]


def join_keys(found: list[str], parts: tuple[int, int] = (FIRST, SECOND)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word index, key, shorter)``: the keys under which words meet.  ``shorter``
    tells the keys under which a word stands as (one of) the shorter of a pair."""
    lengths = np.array([len(w) for w in found], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    letters = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.int64)
    signed = signatures(letters, first, parts)
    at, keys, short = [], [], []
    for less in (0, 1):
        length = lengths - less
        use = np.flatnonzero(length >= LEAST_LENGTH)
        for side, half in enumerate(_halves(letters, first, length)):
            place = mix64(half + mix64((length * 2 + side).astype(np.uint64)))
            for s in range(signed.shape[1]):
                keys.append(mix64(place + signed[:, s])[use])
                at.append(use)
                short.append(np.full(len(use), less == 0))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(short)


def _keyed(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        at, keys, short = join_keys(batch.column("word").to_pylist())
        taken = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(short), taken.column("word"), taken.column("n")], ["key", "short", "word", "n"])


def near_pairs(counted: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair of near words, once."""
    keyed = counted.select("word", "n").mapInArrow(_keyed, "key long, short boolean, word string, n long")
    a = keyed.where("short").select("key", F.col("word").alias("word"), F.col("n").alias("n"))
    b = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("short").alias("same_length"))
    once = ~F.col("same_length") | (F.col("word") < F.col("other"))
    met = a.join(b, "key").where(once & (F.levenshtein("word", "other", 1) == 1))
    return met.select("word", "n", "other", "other_n").distinct()


def forms(counted: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n``: each word with its near words' count and its form."""
    pairs = near_pairs(counted)
    way = lambda a, b, n: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(n).alias("other_n"))
    both = pairs.select(F.inline(F.array(way("word", "other", "other_n"), way("other", "word", "n"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    joined = counted.join(best, "word", "left")
    is_form = -F.col("best.less") >= FORM_TIMES * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds ``root``, the end of each word's chain of forms (the word itself if it has none)."""
    most = formed.where(F.col("form").isNotNull()).agg(F.max("form_n")).first()[0]
    if most is None:
        return formed.withColumn("root", F.col("word"))
    steps = max(1, int(math.log10(most)))  # each step multiplies the count by ten, from two on
    chain = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = store(chain.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-chain")
    joined = formed.join(chain, "word", "left")
    return joined.withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``
    (``doc_id``, ``text``)."""
    ship(docs.sparkSession)
    counted = store(words(docs), "spelling-words")
    formed = store(forms(counted), "spelling-forms")
    discard(counted)
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
