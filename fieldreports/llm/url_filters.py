"""URL filters: the ratio of two character language models.

Host and path rules accept or reject what they cover.  Two smoothed
variable-order Markov models are learned from the characters of all accepted
and of all rejected urls; a url that no rule covers is judged by the difference
of its log-likelihoods per character against a threshold that is calibrated on
covered urls which the models did not see.

The models keep contexts of up to ``ORDER`` characters and mix each order with
the next lower one by the number of different characters seen after the context
(Witten-Bell).  Every gram of both sides is kept, in a stored table
(``gram_values``); tasks get the values of the frequent grams, up to a fixed
number, and the other grams of the urls are joined with the table.

Defined results: a null url, an empty one, or one without ``://``, has an empty host
and path; a null or empty url scores 0; a score equal to the threshold is accepted;
equal urls get equal scores (sums are of integers), and repeated rows are learned
from and judged one by one; a very long url is read whole, in one task; an empty
table gives an empty one; other columns, whatever their names, are not read.
Without urls of both kinds the method accepts.
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

ORDER = 5
BITS = 6
HELD_OUT = 5  # one in so many covered urls calibrates the threshold
SCORE_BINS = 400
SCORE_RANGE = 4.0

#: The rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Symbols: letters regardless of case, one for digits, these marks, one for the rest.
MARKS = "/.-_?=&#%:~+@,;!"
SYMBOLS = 2 + 26 + len(MARKS) + 1  # 0 is the place before the first character
SHAPE = gram_values.Shape(ORDER + 1, BITS, 2)


def _symbol_table() -> np.ndarray:
    table = np.full(256, SYMBOLS - 1, np.uint64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = table[ord(c.upper())] = 1 + i
    table[ord("0") : ord("9") + 1] = 27
    for i, c in enumerate(MARKS):
        table[ord(c)] = 28 + i
    return table


_SYMBOL = _symbol_table()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z only) and the path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every character its last ORDER + 1 symbols, packed (the newest in the
    lowest bits), and the characters of each url."""
    lengths = np.diff(offsets)
    url = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(raw)) - offsets[url]
    symbols = _SYMBOL[raw]
    packed = symbols.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(symbols)
        before[k:] = symbols[:-k]
        packed |= np.where(place >= k, before, np.uint64(0)) << np.uint64(BITS * k)
    return packed, lengths


def witten_bell(grams: dict, contexts: dict) -> np.ndarray:
    """Log probabilities (grams x sides): each order is mixed with the next lower one
    by the number of different characters after its context."""
    p = np.full(grams[1].shape, 1.0 / SYMBOLS)
    for k in range(1, ORDER + 2):
        total, kinds = contexts[k]
        p = np.where(total > 0, (grams[k] + kinds * p) / np.where(total > 0, total + kinds, 1), p)
    return np.log(p)


def _difference(grams: dict, contexts: dict) -> np.ndarray:
    logs = witten_bell(grams, contexts)
    return logs[:, 1:] - logs[:, :1]


@dataclass
class Model:
    """The stored table of both sides (0 rejected, 1 accepted) and the threshold."""

    table: DataFrame | None = None
    root: tuple[np.ndarray, np.ndarray] | None = None
    head: Broadcast | None = None
    threshold: float = -np.inf

    def values(self, grams: DataFrame) -> DataFrame:
        """``gram, logs``: the difference of the log probabilities of any grams."""
        return gram_values.values(grams, self.table, SHAPE, self.root, _difference)


def scored(urls: DataFrame, model: Model) -> tuple[DataFrame, list[DataFrame]]:
    """The columns but ``url`` with ``score``, the log-likelihood difference per byte
    (0 of an empty url), and the stored steps that the frame reads."""
    if model.table is None:
        return urls.withColumn("score", F.lit(0.0)).drop("url"), []
    summed, step = gram_values.sums(urls, "url", _grams, model.head, 1, model.values)
    score = F.when(F.col("chars") > 0, F.col("sums")[0] / gram_values.SCALE / F.col("chars")).otherwise(0.0)
    return summed.select(*[c for c in urls.columns if c != "url"], score.alias("score")), [step]


def counted(covered: DataFrame) -> DataFrame:
    """``col, gram, n`` of the urls (``url``, ``good`` 0 or 1) that teach (stored)."""

    def count(batches):
        for batch in batches:
            raw, offsets = string_buffers(batch.column(0))
            good = batch.column(1).to_numpy()
            for i, j in chunks(offsets):
                packed, lengths = _grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                side_of = np.repeat(good[i:j], lengths)
                for side in (0, 1):
                    keys, n = np.unique(packed[side_of == side], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), side, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["col", "gram", "n"])

    return store(covered.mapInArrow(count, "col int, gram long, n long").groupBy("col", "gram").agg(F.sum("n").alias("n")), "url-grams")


def learn(counts: DataFrame) -> Model:
    """The model of :func:`counted` grams; only the bounded head comes to the driver."""
    levels = store(gram_values.level_table(counts, SHAPE, continuation=False), "url-levels")
    table = store(gram_values.model_table(levels, SHAPE), "url-model")
    discard(levels)
    model = Model(table, gram_values.roots(table, SHAPE), threshold=0.0)
    if not model.root[0].all():  # a side without a character
        discard(table)
        return Model()
    head = gram_values.head_of(model.values(gram_values.frequent(counts, SHAPE)), 1)
    model.head = counts.sparkSession.sparkContext.broadcast(head)  # at most HEAD_CELLS values
    return model


def fit(judged: DataFrame) -> Model:
    """Models from all urls that a rule covers (``url``, ``verdict``), and the
    threshold that best separates the held-out ones (mean of both hit rates)."""
    covered = judged.where(F.col("verdict").isNotNull() & F.col("url").isNotNull()).select("url", (F.col("verdict") == "allow").cast("int").alias("good"))
    held = F.pmod(F.xxhash64("url", F.lit(2)), F.lit(HELD_OUT)) == 0
    counts = counted(covered.where(~held))
    model = learn(counts)
    discard(counts)
    if model.table is None:
        return model
    bins = F.least(F.greatest(F.floor((F.col("score") + SCORE_RANGE) / (2 * SCORE_RANGE) * SCORE_BINS), F.lit(0)), F.lit(SCORE_BINS - 1)).cast("int")
    table = np.zeros((2, SCORE_BINS))
    tried, steps = scored(covered.where(held), model)
    for r in tried.groupBy("good", bins.alias("bin")).count().collect():
        table[r["good"], r["bin"]] = r["count"]
    discard(*steps)
    if table.sum(1).min() > 0:
        below = np.concatenate(([0.0], np.cumsum(table[0]) / table[0].sum()))
        above = 1 - np.concatenate(([0.0], np.cumsum(table[1]) / table[1].sum()))
        value = below + above
        best = np.flatnonzero(value >= value.max() - 1e-12)
        model.threshold = float(best.mean() / SCORE_BINS * 2 * SCORE_RANGE - SCORE_RANGE)
    return model


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page."""
    ship(pages.sparkSession)
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    parts = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", rule).withColumn("verdict", said)
    model = fit(judged)
    found, steps = scored(judged, model)
    method = F.when(F.col("score") >= float(model.threshold), F.lit("allow")).otherwise(F.lit("block"))
    out = found.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")
    if model.table is None:
        return out
    out = store(out, "urls")
    discard(model.table, *steps)
    return out
