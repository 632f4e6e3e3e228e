"""Quality rules: gradient-boosted trees over document statistics.

Statistics are taken in one vectorised pass over whole texts.  The trees are
fitted on a bounded sample of labelled rows with second-order gradients of the
logistic loss, histogram splits and monotone constraints, then flattened into
numpy node arrays and scored level by level for a whole batch.

Defined results: a null or empty text has no words, so its base rule fails and
it is not kept; equal texts get equal results; an empty table gives an empty
table; without two label classes the method keeps whatever passes the base rules.
Other columns of the documents are ignored here and passed through by
:func:`keep_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldreports.llm.common import Words, chunks, mix64, ship, span_ids, string_buffers

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

FOLDS = 3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_digits", "n_capitals", "n_marks", "n_stops", "n_lines", "n_distinct", "longest_word", "n_bytes")

#: The features and the sign their effect on quality may have (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "digits_per_char": 0,
    "capitals_per_char": 0,
    "marks_per_word": 0,
    "stops_per_word": 0,
    "words_per_line": 0,
    "distinct_share": 1,
    "log_longest_word": 0,
    "bytes_per_char": 0,
}


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL, _DIGIT, _CAPITAL = _table(SYMBOLS), _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK, _STOP = _table(",;:!?.'\"()-"), _table(".!?")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more, and is it a first occurrence."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    again = np.zeros(len(s), bool)
    again[:-1] = ~new[1:]
    many, firsts = np.zeros(len(s), bool), np.zeros(len(s), bool)
    many[order] = again | ~new
    firsts[order] = new
    return many, firsts


def _in_text(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers that only equal ids of one text share."""
    return text.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids


def _window_ids(ids: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of ``size`` words inside one text, equal for equal runs
    only, and the index of each run's first word."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(ids)) + size <= ends)
    out = ids[at]
    for k in range(1, size):
        wide = int(ids.max(initial=0)) + 1
        if int(out.max(initial=0)) >= (1 << 62) // wide:  # pairs do not fit a number: count them off first
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
        out = out * wide + ids[at + k]
    return out, at


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """int64 array (texts x COUNTS) of a run of texts."""
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    put = lambda name, v: out.__setitem__((slice(None), COUNTS.index(name)), v)
    put("n_bytes", np.diff(offsets))
    if not len(raw):
        return out
    w = Words(raw, offsets)
    text = w.text_of
    put("n_words", w.counts)
    lead = (raw & 0xC0) != 0x80
    put("word_chars", _per_text(w.is_word_byte & lead, offsets))
    for name, t in (("n_symbols", _SYMBOL), ("n_digits", _DIGIT), ("n_capitals", _CAPITAL), ("n_marks", _MARK), ("n_stops", _STOP)):
        put(name, _per_text(t[raw], offsets))
    # lines: \n-split pieces that hold a word
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    newline = raw == 10
    begins = np.flatnonzero(edge[:-1] | np.concatenate(([False], newline[:-1])))
    stops = np.empty(len(begins), np.int64)
    stops[:-1], stops[-1] = begins[1:], len(raw)
    stops = stops - (newline[stops - 1] & (stops > begins))
    some = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(w.is_word_byte, out=some[1:])
    full = some[stops] > some[begins]
    begins, stops = begins[full], stops[full]
    line_text = np.searchsorted(offsets, begins, side="right") - 1
    in_line = np.zeros(len(raw) + 1, np.int8)
    in_line[begins] += 1
    np.subtract.at(in_line, stops, 1)
    lines = span_ids(raw, np.cumsum(in_line[:-1]) > 0, stops - begins)
    _, firsts = _repeated(_in_text(lines, line_text))
    put("n_lines", np.bincount(line_text, minlength=n))
    put("n_dup_lines", np.bincount(line_text[~firsts], minlength=n))
    # words in repeated three-word windows
    runs, at = _window_ids(w.ids, w.first, 3)
    # only equal runs can be of one text's: number those that occur twice at all
    many, _ = _repeated(runs)
    runs, at = np.unique(runs[many], return_inverse=True)[1], at[many]
    many, _ = _repeated(_in_text(runs, text[at]))
    hit = np.zeros(len(w.ids), bool)
    for k in range(3):
        hit[at[many] + k] = True
    put("n_repeat_words", np.bincount(text[hit], minlength=n))
    _, firsts = _repeated(_in_text(w.ids, text))
    put("n_distinct", np.bincount(text[firsts], minlength=n))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, w.ends - w.starts)
    put("longest_word", longest)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """float32 array (rows x FEATURES) of the counts."""
    c = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    cols = {
        "log_words": np.log1p(c["n_words"]),
        "mean_word_chars": c["word_chars"] / words,
        "symbols_per_char": c["n_symbols"] / chars,
        "dup_line_share": c["n_dup_lines"] / lines,
        "repeat_word_share": c["n_repeat_words"] / words,
        "digits_per_char": c["n_digits"] / chars,
        "capitals_per_char": c["n_capitals"] / chars,
        "marks_per_word": c["n_marks"] / words,
        "stops_per_word": c["n_stops"] / words,
        "words_per_line": c["n_words"] / lines,
        "distinct_share": c["n_distinct"] / words,
        "log_longest_word": np.log1p(c["longest_word"]),
        "bytes_per_char": c["n_bytes"] / chars,
    }
    return np.column_stack([cols[k] for k in FEATURES]).astype(np.float32)


# ---------------------------------------------------------------- the trees


@dataclass
class Trees:
    """Flat node arrays: node i tests ``x[feature[i]] <= cut[i]`` and goes to
    ``left[i]`` or ``left[i] + 1``; a leaf has feature -1 and points to itself."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    bias: float = 0.0
    depth: int = 0
    cutoff: float = -np.inf  # rows at or above it are kept

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for every row, level by level."""
        total = np.full(len(x), self.bias, np.float64)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node).astype(np.int32)
            total += self.value[node]
        return total


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    signs: tuple[int, ...] = tuple(FEATURES.values()),
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 0.5,
) -> Trees:
    """Second-order boosting of the logistic loss with monotone constraints.

    A split on a constrained feature is allowed only if its leaf values are
    ordered by the sign, and both sides inherit the midpoint as a bound, so
    every tree, and hence the sum, is monotone in that feature.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    width = bins + 1
    rate_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_good / (1 - rate_good)))
    margin = np.full(len(y), bias)
    feature, cut, left, value, roots = [], [], [], [], []

    def new() -> int:
        feature.append(-1), cut.append(0.0), left.append(len(feature) - 1), value.append(0.0)
        return len(feature) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = new()
        roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            value[node] = float(np.clip(-sum_g / (sum_h + ridge), low, high)) * rate
            best = (1e-3, None)
            if level < depth and len(rows) > 1:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], width))[: len(c)]
                    hl = np.cumsum(np.bincount(b, h[rows], width))[: len(c)]
                    gr, hr = sum_g - gl, sum_h - hl
                    vl = np.clip(-gl / (hl + ridge), low, high)
                    vr = np.clip(-gr / (hr + ridge), low, high)
                    gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2)
                    v0 = np.clip(-sum_g / (sum_h + ridge), low, high)
                    gain += sum_g * v0 + (sum_h + ridge) * v0**2 / 2
                    ok = (hl >= least) & (hr >= least) & (signs[j] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                margin[rows] += value[node]
                continue
            j, k, vl, vr = best[1]
            feature[node], cut[node] = j, float(cuts[j][k])
            left[node] = new()
            new()
            goes = binned[rows, j] > k
            mid = (vl + vr) / 2
            a, b = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high),) * 2
            todo += [(left[node], rows[~goes], *a, level + 1), (left[node] + 1, rows[goes], *b, level + 1)]
    return Trees(np.array(feature, np.int32), np.array(cut, np.float32), np.array(left, np.int32), np.array(value, np.float32), np.array(roots, np.int32), bias, depth)


# ---------------------------------------------------------------- on Spark

_COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def _batches(batches, model: Trees | None):
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        parts = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
        counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
        if model is None:
            cols = [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS])
            continue
        words, repeated = counts[:, BASE.index("n_words")], counts[:, BASE.index("n_repeat_words")]
        failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * words)
        margin = model.margin(features(counts))
        kept = ~failed & (margin >= model.cutoff)
        cols = [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(margin)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "kept", "margin"])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all counts of every document's whole text."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b: _batches(b, None), f"doc_id {kind}, {_COUNT_SCHEMA}")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_lost: float = 0.002) -> Trees:
    """Trees from at most ``most_rows`` labelled documents (the lowest seeded
    hashes of the label rows; a document's contradicting labels count as bad).

    The cutoff is set on margins of rows that the trees behind them did not see
    (``FOLDS`` folds); the trees returned are fitted on all of the sample.
    """
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id")
        .limit(most_rows)
    )
    # at most most_rows pairs of numbers, so a broadcast of proven size
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = measure(chosen).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in (*COUNTS, "good")])
    got = rows.orderBy("doc_id").toPandas()
    y = (got["good"].to_numpy() > 0).astype(np.float64) if len(got) else np.zeros(0)
    if len(y) < 20 or y.min() == y.max():
        return Trees()
    x = features(got[list(COUNTS)].to_numpy())
    fold = mix64(np.arange(len(y), dtype=np.uint64)) % np.uint64(FOLDS)
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        unseen[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    trees = fit_trees(x, y)
    trees.cutoff = cutoff(unseen, y, most_lost)
    return trees


def cutoff(margin: np.ndarray, y: np.ndarray, most_lost: float) -> float:
    """Half way between the lowest good margins, but for a share ``most_lost``,
    and the highest bad one below them; never above even odds."""
    good, bad = np.sort(margin[y > 0]), margin[y == 0]
    low = good[int(most_lost * len(good))]
    below = bad[bad < low]
    return min(0.0, float((low + below.max()) / 2 if len(below) else low) - 1e-9)


def judge(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``margin`` of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand tree nodes, whatever the corpus
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, margin double"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda b: _batches(b, sent.value), schema)


def keep_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents that the rules keep, all columns as they were (no shuffle)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at)] * 2, names=["doc_id", "text"])
            for judged in _batches([pair], sent.value):
                yield batch.filter(judged.column(judged.schema.get_field_index("kept")))

    return docs.mapInArrow(run, docs.schema)
