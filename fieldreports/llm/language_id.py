"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters per language, counted over all training
documents; a document gets the language with the lowest cross-entropy per
character.  Counts, continuation counts and contexts are a stored table with one
entry per gram and language that occur together (``gram_values``).  Tasks look up the
frequent grams in sorted arrays of bounded size; all other grams of the documents
are joined with the table.

Texts are reduced to lower-case letters and single spaces between runs of them.
A part of the training documents is kept out of the counts and calibrates the
score (the chance that the prediction is right, from the lead over the second
language) and the cross-entropy above which a document counts as ``rejected``.

Defined results: a null text, an empty one, or one without a letter, is ``und``
with score 0; equal texts get equal results (sums are of integers); of languages
with equal cross-entropy the first by code point is taken, with lead 0; repeated
rows train and are predicted one by one; a very long text is read whole, in one
task; an empty table gives an empty one, and without training documents everything
is ``und``; a document without an id never trains and is not held out; other
columns, whatever their names, are not read.  Letters beyond U+FFFF share symbols
with others (16 bits a symbol).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.llm import gram_values
from fieldreports.llm.common import chunks, discard, ship, store, string_buffers

ORDER = 4
BITS = 16
CALIBRATES = 10  # one in so many training documents
SPACE = 32
UNKNOWN = "und"
LEAD_BINS, LEAD_MOST = 80, 40.0
ENTROPY_BINS, ENTROPY_MOST = 400, 20.0
REJECTED_SHARE = 0.001

_UNSEEN = np.uint64(0xFFFFFFFF)
_letters: list[np.ndarray] = []


def _reduced(points: np.ndarray) -> np.ndarray:
    """Each code point as a lower-case letter (folded to 16 bits) or as a space.

    The table is filled for the code points that occur, once per process."""
    if not _letters:
        _letters.append(np.full(0x110000, _UNSEEN, np.uint64))
    table = _letters[0]
    out = table[points]
    new = out == _UNSEEN
    if new.any():
        for c in np.unique(points[new]).tolist():
            ch = chr(c)
            low = ch.lower() if ch.isalpha() else " "
            folded = ord(low[0]) & 0xFFFF
            table[c] = SPACE if low == " " else folded if folded != SPACE else 0xFFFE
        out = table[points]
    return out


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed symbols (newest lowest) of every letter or single space after one,
    and the number of them in each text."""
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    symbols = _reduced(np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    space = symbols == SPACE
    after = np.ones(len(symbols), bool)  # after a space, or first
    after[1:] = space[:-1]
    after[at[:-1][np.diff(at) > 0]] = True
    keep = ~(space & after)
    symbols, text = symbols[keep], text[keep]
    counts = np.bincount(text, minlength=len(at) - 1)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    packed = symbols.copy()
    for k in range(1, ORDER):
        before = np.full(len(symbols), SPACE, np.uint64)
        before[k:] = symbols[:-k]
        packed |= np.where(place >= k, before, np.uint64(SPACE)) << np.uint64(BITS * k)
    return packed, counts


def kneser_ney(grams: dict, contexts: dict, discounts: np.ndarray, alphabet: int) -> np.ndarray:
    """Log probabilities (grams x languages) from counts of each order and its contexts:
    the discounted share, and the mass left over times the next lower order."""
    p = np.full(grams[1].shape, 1.0 / alphabet)
    for k in range(1, ORDER + 1):
        total, kinds = contexts[k]
        seen = total > 0
        share = 1 / np.where(seen, total, 1)
        p = np.maximum(grams[k] - discounts[k - 1], 0) * share + np.where(seen, discounts[k - 1] * kinds * share, 1.0) * p
    return np.log(p)


@dataclass
class Models:
    """The stored model table, what is needed to read it, and the calibration."""

    languages: tuple[str, ...] = ()
    table: DataFrame | None = None
    discounts: np.ndarray | None = None  # orders x languages
    alphabet: int = 1
    root: tuple[np.ndarray, np.ndarray] | None = None
    head: Broadcast | None = None
    slope: float = 1.0
    shift: float = 0.0
    most_entropy: float = np.inf

    def values(self, grams: DataFrame) -> DataFrame:
        """``gram, logs`` (fixed-point log probabilities by language) of any grams."""
        discounts, alphabet = self.discounts, self.alphabet
        return gram_values.values(grams, self.table, _shape(self.languages), self.root, lambda g, c: kneser_ney(g, c, discounts, alphabet))


def _shape(languages) -> gram_values.Shape:
    return gram_values.Shape(ORDER, BITS, len(languages))


def _crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(_crc(doc_id), F.lit(3)) == 1, F.lit(False))


def _train_part(doc_id: Column) -> tuple[Column, Column]:
    learns = F.pmod(_crc(doc_id), F.lit(3)) != 1
    calibrates = F.pmod(F.floor(_crc(doc_id) / 3), F.lit(CALIBRATES)) == 0
    return learns & ~calibrates, learns & calibrates


def _count_grams(batches):
    """``lang, gram, n`` of a partition, summed before they leave the task."""
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def merged(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        raw, offsets = string_buffers(batch.column(0))
        names, which = np.unique(np.asarray(batch.column(1).to_pylist(), dtype=str), return_inverse=True)
        for i, j in chunks(offsets):
            packed, counts = _grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            lang = np.repeat(which[i:j], counts)
            for k in np.unique(which[i:j]):
                keys, n = np.unique(packed[lang == k], return_counts=True)
                kept.setdefault(str(names[k]), []).append((keys, n))
                waiting += len(keys)
            if waiting > 2_000_000:
                kept = {name: [merged(parts)] for name, parts in kept.items()}
                waiting = 0
    for name, parts in sorted(kept.items()):
        keys, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def predict(docs: DataFrame, models: Models, *carry: str) -> tuple[DataFrame, list[DataFrame]]:
    """The columns ``carry`` with ``lang_pred, score, lead, entropy``, and the stored
    steps that the frame reads."""
    ship(docs.sparkSession)
    if not models.languages:
        none = F.lit(0.0)
        return docs.select(*carry, F.lit(UNKNOWN).alias("lang_pred"), none.alias("score"), none.alias("lead"), none.alias("entropy")), []
    texts = docs.select(F.col("text").cast("string").alias("text"), *carry)
    summed, stored = gram_values.sums(texts, "text", _grams, models.head, len(models.languages), models.values)
    some, chars = F.col("chars") > 0, F.greatest("chars", F.lit(1))
    ranked = F.sort_array("sums", asc=False)
    second = ranked[1] if len(models.languages) > 1 else ranked[0]
    names = F.array(*[F.lit(x) for x in models.languages])
    best = F.element_at(names, F.array_position("sums", ranked[0]).cast("int"))
    lead = F.when(some, (ranked[0] - second) / gram_values.SCALE / F.sqrt(chars)).otherwise(0.0)
    logit = F.greatest(F.least(F.col("lead") * float(models.slope) + float(models.shift), F.lit(30.0)), F.lit(-30.0))
    out = summed.select(
        *carry,
        F.when(some, best).otherwise(UNKNOWN).alias("lang_pred"),
        lead.alias("lead"),
        F.when(some, -ranked[0] / gram_values.SCALE / chars).otherwise(0.0).alias("entropy"),
        some.alias("with_letters"),
    )
    score = F.when(F.col("with_letters"), 1 / (1 + F.exp(-logit))).otherwise(0.0)
    return out.select(*carry, "lang_pred", score.alias("score"), "lead", "entropy"), [stored]


def _platt(right: np.ndarray, wrong: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic fit to counts of right and wrong at x."""
    n1, n0 = right.sum(), wrong.sum()
    t1, t0 = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    a, b = 1.0, 0.0
    weight = right + wrong
    target = np.where(weight > 0, (right * t1 + wrong * t0) / np.maximum(weight, 1), 0.5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - target)
        h = np.maximum(weight * p * (1 - p), 1e-9)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [(g * x).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = float(np.clip(a - np.clip(da, -1, 1), 1e-3, 20)), float(np.clip(b - np.clip(db, -2, 2), -20, 20))
    return a, b


def counted(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over the training documents that do not calibrate (stored)."""
    ship(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & _train_part(F.col("doc_id"))[0])
    texts = usable.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    grams = texts.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return store(grams, "grams")


def learn(grams: DataFrame) -> Models:
    """Models of :func:`counted` grams.  Only numbers by language and order, and the
    values of the bounded head, come to the driver."""
    languages = tuple(sorted(r[0] for r in grams.select("lang").distinct().collect()))
    if not languages:
        return Models()
    shape = _shape(languages)
    names = F.array(*[F.lit(x) for x in languages])
    counts = grams.select((F.array_position(names, F.col("lang")) - 1).cast("int").alias("col"), "gram", "n")
    levels = store(gram_values.level_table(counts, shape, continuation=True), "gram-levels")
    discounts = np.zeros((ORDER, len(languages)))
    ones, twos = (F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2))
    for r in levels.groupBy("kind", "col").agg(ones, twos).collect():
        discounts[r["kind"] - 1, r["col"]] = (r["n1"] + 0.5) / (r["n1"] + 0.5 + 2 * (r["n2"] + 0.5))
    alphabet = levels.where("kind = 1").select("key").distinct().count() + 1
    table = store(gram_values.model_table(levels, shape), "gram-model")
    discard(levels)
    models = Models(languages, table, discounts, alphabet, gram_values.roots(table, shape))
    head = gram_values.head_of(models.values(gram_values.frequent(counts, shape)), len(languages))
    models.head = grams.sparkSession.sparkContext.broadcast(head)  # at most HEAD_CELLS values
    return models


def fit(docs: DataFrame) -> Models:
    """Models from all documents that train (``doc_id, text, lang``).

    Every gram that occurs is kept, so discounts and continuation counts are those
    of the corpus; the calibration reads histograms only.
    """
    grams = counted(docs)
    models = learn(grams)
    discard(grams)
    if not models.languages:
        return models
    held = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & _train_part(F.col("doc_id"))[1])
    tried, steps = predict(held, models, "lang")
    lead = F.least(F.floor(F.col("lead") / (LEAD_MOST / LEAD_BINS)), F.lit(LEAD_BINS - 1)).cast("int")
    entropy = F.least(F.floor(F.col("entropy") / (ENTROPY_MOST / ENTROPY_BINS)), F.lit(ENTROPY_BINS - 1)).cast("int")
    tried = tried.where(F.col("lang_pred") != UNKNOWN)
    seen = tried.groupBy(lead.alias("lead"), entropy.alias("entropy"), (F.col("lang") == F.col("lang_pred")).alias("right")).count().collect()
    discard(*steps)
    leads, entropies = np.zeros((2, LEAD_BINS)), np.zeros(ENTROPY_BINS)
    for r in seen:
        leads[int(r["right"]), r["lead"]] += r["count"]
        entropies[r["entropy"]] += r["count"] * r["right"]
    if leads.sum() > 0:
        models.slope, models.shift = _platt(leads[1], leads[0], (np.arange(LEAD_BINS) + 0.5) * LEAD_MOST / LEAD_BINS)
    if entropies.sum() > 0:
        share = np.cumsum(entropies) / entropies.sum()
        models.most_entropy = float((np.searchsorted(share, 1 - REJECTED_SHARE) + 1) * ENTROPY_MOST / ENTROPY_BINS)
    return models


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected`` of every document."""
    models = fit(docs)
    found, steps = predict(docs, models, "doc_id")
    out = found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", (F.col("entropy") > float(models.most_entropy)).alias("rejected")
    )
    if not models.languages:
        return out
    out = store(out, "languages")
    discard(models.table, *steps)
    return out
