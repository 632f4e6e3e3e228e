"""Secret scans: patterns, and a battery of randomness tests.

Base spans come from three patterns.  The method adds runs of encoded
characters that pass a battery against the hypothesis of uniform random
characters of their inferred encoding: chi-squared uniformity of the alphabet,
a runs test over character classes and lag-one serial correlation, joined by
Bonferroni.  The shorter a run, the weaker the tests, so acceptance is under
false-discovery control by stratum of encoding and length: the least p-value
that is accepted is the smallest of a grid at which the expected number of
word-like runs among the accepted stays below ``FALSE_SHARE``.

Only DataFrame operations are used.  Two passes over the texts without any
shuffle of them; between them come at most ``strata`` rows of counts.  A text
costs time in proportion to its length and its spans: positions are running sums
that are folded in blocks, and texts are put together from pieces.

Defined results: a null text counts as empty and has no spans; a very long text is
scanned whole, in one row; equal texts and repeated rows have equal spans; spans
that start together go by kind, then end; an empty table gives an empty table;
``scan`` passes other columns on, ``redact`` also those with the names used here.
Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery judges, and its parameters.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
FALSE_SHARE = 0.01
ALPHAS = (0.0001, 0.001, 0.01, 0.05, 0.1, 0.2)
#: Encodings: pattern, size of the alphabet, shares of lower, upper, digit and other.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, (6 / 16, 0, 10 / 16, 0)),
    ("base32", r"^[A-Z2-7]+=*$", 32, (0, 26 / 32, 6 / 32, 0)),
    ("base62", r"^[A-Za-z0-9]+$", 62, (26 / 62, 26 / 62, 10 / 62, 0)),
    ("base64", r".", 64, (26 / 64, 26 / 64, 10 / 64, 2 / 64)),
)
#: The chance that two letters of word-like text agree is at least this.
COINCIDENCE = 0.06


_SPAN = "struct<start:int,kind:int,end:int>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, step, start: int = 0) -> Column:
    """Running results of ``step`` over an array of integers, each value included.

    Folded in blocks of about the square root of the length, then over the blocks:
    a fold that appends to an array copies it at every step."""

    def of(v: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v))).cast("int"))

        def append(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(step(F.element_at(acc, -1), x)))

        def blocks(w: Column) -> Column:
            first = F.sequence(F.lit(1), F.size(v), w)
            begin = F.array(F.lit(start))
            local = F.transform(first, lambda k: F.aggregate(F.slice(v, k, w), begin, append))
            return _let(
                local,
                lambda parts: _let(
                    F.aggregate(parts, begin, lambda acc, p: append(acc, F.element_at(p, -1))),
                    lambda before: F.flatten(
                        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.transform(F.slice(F.element_at(parts, k), 2, w), lambda x: step(F.element_at(before, k), x)))
                    ),
                ),
            )

        return F.when(F.size(v) > 0, _let(width, blocks)).otherwise(F.array().cast("array<int>"))

    return _let(values, of)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, kind: int, least: Column | None = None, with_match: bool = False) -> Column:
    """Spans ``(start, kind, end)``, with ``match`` its text, of the leftmost matches that do not overlap.

    The pieces between the matches and the matches themselves alternate, so
    running sums of their lengths are the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(m: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda b, x: F.length(b) + F.length(x))
        rows = F.arrays_zip(_running(lengths, _sum).alias("end"), m.alias("match"), *([least.alias("value")] if least is not None else []))
        rows = rows if least is None else F.filter(rows, lambda x: F.length(x["value"]) >= LEAST_ASSIGNED)
        span = lambda x: [(x["end"] - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")]
        return F.transform(rows, lambda x: F.struct(*span(x), *([x["match"].alias("match")] if with_match else [])))

    none = F.array().cast(f"array<{_SPAN[:-1]},match:string>>" if with_match else f"array<{_SPAN}>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(matches, of)).otherwise(none)


#: Code points of a text that are cut off together, so that a span is found
#: without counting from the text's beginning.
CUT = 1024


def _spliced(text: Column, spans: Column, piece) -> Column:
    """The text with spans (sorted by their start) replaced: ``piece(cut, before,
    span)`` is what follows the end ``before`` of all earlier spans, up to the
    span's own end; ``cut(a, b)`` is the text between two positions."""

    def of(blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / CUT).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / CUT).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(some, a - first * CUT + 1, b - a)).otherwise(F.lit(""))

        ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return _let(
            ends,
            lambda e: F.concat(
                F.array_join(F.transform(spans, lambda s, i: piece(cut, F.when(i > 0, F.get(e, i - 1)).otherwise(0), s)), ""),
                cut(F.element_at(e, -1), F.length(text)),
            ),
        )

    return F.when(F.size(spans) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), of)).otherwise(text)


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``base``: sorted spans of the three patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(_found(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), _found(text, ACCESS, 1), _found(text, HEX, 2))
    return docs.withColumn("base", F.array_sort(found))


def _upper(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, to about 1e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * F.pow(z, F.lit(3))))


def _by_encoding(run: Column, values) -> Column:
    out = F.lit(values[-1])
    for (_, pattern, _, _), value in list(zip(ENCODINGS, values))[-2::-1]:
        out = F.when(F.regexp_like(run, F.lit(pattern)), F.lit(value)).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """``struct<encoding, n, p>`` of a run: p is small where it does not look random."""
    n = F.length(run).cast("double")
    size = _by_encoding(run, [float(e[2]) for e in ENCODINGS])
    chars = F.split(run, "(?!^)")
    squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(run, c, F.lit(""))), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    chi = size / n * squares - n
    z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(run, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    changes = F.length(F.regexp_replace(F.regexp_replace(classes, r"(.)(?=\1)", ""), "^.", "")).cast("double")
    differ = _by_encoding(run, [float(1 - sum(s * s for s in e[3])) for e in ENCODINGS])
    z_runs = (changes - (n - 1) * differ) / F.sqrt((n - 1) * differ * (1 - differ))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def serial(off: Column) -> Column:
        spread = total(F.transform(off, lambda x: x * x))
        lagged = total(F.zip_with(off, F.slice(off, F.lit(2), F.size(off)), lambda x, y: F.coalesce(x * y, F.lit(0.0))))
        return _let(spread, lambda v: F.when(v > 0, (lagged / v + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)))

    # bound values: a lambda would compute the mean again for every character
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    z_serial = _let(codes, lambda x: _let(total(x) / n, lambda mean: _let(F.transform(x, lambda v: v - mean), serial)))
    least = F.least(_upper(z_chi), 2 * _upper(F.abs(z_runs)), 2 * _upper(F.abs(z_serial)))
    return F.struct(_by_encoding(run, list(range(len(ENCODINGS)))).alias("encoding"), n.alias("n"), F.least(F.lit(1.0), 3 * least).alias("p"))


def _length_bin(n: Column) -> Column:
    return F.least(F.floor(n / 8), F.lit(16)).cast("int")


def _outside_base(text: Column) -> Column:
    """The text with every character of a base span replaced by a space."""

    def blank(cut, before: Column, s: Column) -> Column:
        start = F.greatest(before, s["start"])
        return F.concat(cut(before, start), F.repeat(F.lit(" "), F.greatest(s["end"] - start, F.lit(0))))

    return _spliced(text, F.col("base"), blank)


def with_runs(docs: DataFrame) -> DataFrame:
    """Adds ``runs``: spans outside the base spans, with the battery's results.
    Of a run that a base span cuts, each part of 20 characters and more is judged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), battery(s["match"]).alias("test"))
    found = docs.withColumn("outside", _outside_base(text)).withColumn("found_runs", _found(F.col("outside"), RUN, 3, with_match=True))
    return found.withColumn("runs", F.transform("found_runs", judged)).drop("outside", "found_runs")


def _word_like_passes(alpha: float, n: Column, encoding: Column) -> Column:
    """Bound on the chance that a word-like run of n characters has p >= alpha:
    its chi-squared statistic is shifted by n times the excess coincidence."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / 3)
    size = F.element_at(F.lit([float(e[2]) for e in ENCODINGS]), encoding + 1)
    shift = n * (size * F.greatest(F.lit(COINCIDENCE), 1.6 / size) - 1)
    return _upper((shift - z * F.sqrt(2 * (size - 1))) / F.sqrt(2 * (size - 1) + 4 * shift))


def thresholds(runs: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[int, int], float]:
    """The least accepted p-value of each stratum ``(encoding, length bin)``;
    strata that cannot be controlled are missing.  At most 4 x 17 rows reach the driver."""
    one = runs.select(F.explode("runs.test").alias("t")).select("t.*").withColumn("bin", _length_bin(F.col("n")))
    counted = one.groupBy("encoding", "bin").agg(
        *[F.sum((F.col("p") >= a).cast("long")).alias(f"passed{i}") for i, a in enumerate(ALPHAS)],
        *[F.sum(_word_like_passes(a, F.col("n"), F.col("encoding"))).alias(f"false{i}") for i, a in enumerate(ALPHAS)],
    )
    out = {}
    for row in counted.collect():
        for i, a in enumerate(ALPHAS):
            if row[f"passed{i}"] > 0 and row[f"false{i}"] <= false_share * row[f"passed{i}"]:
                out[row["encoding"], row["bin"]] = a
                break
    return out


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """The documents with ``base`` and ``spans``: sorted arrays of ``(start, kind, end)``."""
    both = with_runs(with_base(docs))
    least = thresholds(with_runs(with_base(docs.select("text"))), false_share)

    def passes(r: Column) -> Column:
        test, ok = r["test"], F.lit(False)
        for (encoding, length), alpha in sorted(least.items()):
            ok = ok | ((test["encoding"] == encoding) & (_length_bin(test["n"]) == length) & (test["p"] >= alpha))
        return ok

    bare = lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"))
    added = F.transform(F.filter("runs", passes), bare)
    return both.withColumn("spans", F.array_sort(F.concat("base", added))).drop("runs")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their texts replaced by ``mark``
    (overlapping spans by one), and ``n_chars`` set to the new length."""
    found = scan(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}).withColumn("text", F.col("in_text")))

    def marked(cut, before: Column, s: Column) -> Column:
        return F.when(s["start"] >= before, F.concat(cut(before, s["start"]), F.lit(mark))).otherwise(F.lit(""))

    clean = _spliced(F.col("text"), F.col("spans"), marked)
    out = found.withColumn("clean", clean)
    cols = {c: F.col(f"in_{c}") for c in docs.columns}
    cols["text"] = F.col("clean")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("in_n_chars"))
    return out.select(*[v.alias(c) for c, v in cols.items()])
