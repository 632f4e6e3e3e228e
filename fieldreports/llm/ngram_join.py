"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words.  Equal texts form a class (a 128-bit
digest), and the join runs over classes, each with a 64-bit number of its own (a
hash of the digest; classes that would share one get another):

1. MinHash values of each class; classes that agree on a band of ``LANES``
   values share a bucket and are candidates (a pair at the threshold is missed
   with probability ``(1 - 0.8**4)**32``, below 1e-7).
2. Candidates are compared a few MinHash values at a time and dropped when the
   posterior probability of reaching the threshold, under a uniform prior, falls
   below ``TOLERANCE``.  Pairs inside a bucket are not listed: each class is
   compared with the smallest one of its bucket, what survives is joined to
   clusters, and buckets that hold several clusters are then compared inside
   tasks, in blocks, across clusters only; a task sends no more pairs than join
   the clusters it has found.  So two candidates that survive are in one cluster.
3. Inside each cluster all pairs are pruned in the same way and the rest is
   verified exactly on shingles, in blocks of a bounded number of shingles and of
   classes.
   Tasks send the numbers of links of each class, and as many verified pairs as
   join the classes that are linked; their components are the groups.

Defined results: a null text is a group of its own without links; an empty text
and one without words have no shingles and link to nothing, but equal ones are
one class; a text of one to four words is one shingle; repeated rows are copies.
Groups are named by their smallest ``doc_id`` (nulls first); a very long text is read whole, in one task;
an empty table gives an empty one.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.llm.common import Words, chunks, discard, mix64, release, seeded, ship, store, string_buffers, windows
from fieldreports.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # numerator, denominator
HASHES = 128
LANES = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 200_000

_NO_ID = -(2**63)


# ---------------------------------------------------------------- shingles


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and where each text's begin."""
    counts = words.counts
    hashes, at = windows(words.hash, words.first, size)
    text = np.searchsorted(words.first, at, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, factor in enumerate(seeded(99, size - 1) | np.uint64(1)):
            has = counts[short] > k
            whole[has] += words.hash[words.first[short[has]] + k] * factor
        hashes = np.concatenate((hashes, mix64(whole + counts[short].astype(np.uint64))))
        text = np.concatenate((text, short))
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


_SEEDS, _FACTORS = seeded(4, HASHES), seeded(5, HASHES) | np.uint64(1)


def minhashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 array (texts x HASHES): 16 bits of the least value of each function."""
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for i in range(HASHES):
            out[some, i] = mix64(np.minimum.reduceat((hashes ^ _SEEDS[i]) * _FACTORS[i], first[some])) & np.uint64(0xFFFF)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """int64 array (texts x bands) of bucket keys."""
    lanes = np.ascontiguousarray(signatures).view(np.uint64)  # LANES values of 16 bits
    return mix64(lanes ^ seeded(6, lanes.shape[1])).view(np.int64)


@cache
def least_matches(threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest agreeing ones for which
    the posterior (Beta, uniform prior) still gives the threshold a chance of ``tolerance``."""

    def chance(m: int, n: int) -> float:  # P(S >= t) = P(Binomial(n + 1, t) <= m)
        return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return tuple(next(m for m in range(n + 1) if chance(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP))


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (left[i], right[j]) of signature rows are not pruned."""
    alive = np.arange(len(i))
    agree = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        agree[alive] += (left[i[alive], part] == right[j[alive], part]).sum(1, dtype=np.int32)
        alive = alive[agree[alive] >= least]
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


def reaches(shared, n_left, n_right):
    """Jaccard >= threshold, in whole numbers."""
    num, den = THRESHOLD
    return (shared > 0) & (den * shared >= num * (n_left + n_right - shared))


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact numbers of shared shingles of the pairs (i, j) of sorted sets."""
    if len(i) <= 4 * len(sets):
        return np.array([len(a) + len(b) - len(np.union1d(a, b)) for a, b in ((sets[x], sets[y]) for x, y in zip(i, j))], np.int64)
    keys, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(n > 1) - 1  # shingles of one set only are shared by none
    keep = n[at] > 1
    owner, column = owner[keep], column[at[keep]]
    out = np.zeros(len(i), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, most = 2048, int(column[-1]) + 1 if len(column) else 0
    for c in range(0, most, width):
        a, b = np.searchsorted(column, (c, c + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        for r in range(0, len(sets), 256):
            mine = np.flatnonzero((i >= r) & (i < r + 256))
            if len(mine):
                out[mine] += (x[r : r + 256] @ x.T)[i[mine] - r, j[mine]].astype(np.int64)
    return out


# ---------------------------------------------------------------- Arrow helpers


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """Rows of a binary column of fixed width."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _with_class(docs: DataFrame) -> DataFrame:
    """``doc_id, class, text``: the class is a 128-bit digest of the text."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("class"), text.alias("text"))


def _signed(batches):
    """``node, signature, bands`` of the texts of a partition, one row a class."""
    seen: set[int] = set()
    for batch in batches:
        classes = batch.column(0).to_pylist()
        new = [i for i, c in enumerate(classes) if c not in seen and not seen.add(c)]
        if not new:
            continue
        batch = batch.take(pa.array(new))
        raw, offsets = string_buffers(batch.column(1))
        for i, j in chunks(offsets):
            words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes, first = shingles(words)
            signs = minhashes(hashes, first)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                cols = [batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(list(map(bytes, signs[some])), pa.binary()), pa.array(list(bands(signs[some])), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "signature", "bands"])


def _shingled(batches):
    """``node, size, shingles`` (sorted, distinct) of every text."""
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        for i, j in chunks(offsets):
            words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes, first = shingles(words)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first, first[1:])]
            sizes = pa.array([len(x) // 8 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sizes, pa.array(sets, pa.binary())], names=["node", "size", "shingles"])


def _prune(batches):
    """Pairs ``a, b`` whose signatures survive."""
    for batch in batches:
        if batch.num_rows:
            left, right = (_matrix(batch.column(k), np.uint16, HASHES) for k in (2, 3))
            rows = np.arange(batch.num_rows)
            kept = batch.filter(pa.array(survivors(left, right, rows, rows)))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])


def _groups(batches):
    """Whole groups from batches that are sorted by their first column: yields
    ``(edges, table)`` with as many groups as the batches have completed."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        key = table.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1])) if np.all(key[1:] >= key[:-1]) else int(np.flatnonzero(key != key[-1])[-1]) + 1
        rest = table.slice(last)
        if last:
            yield _edges(key[:last]), table.slice(0, last)
    if rest is not None and rest.num_rows:
        yield _edges(rest.column(0).to_numpy()), rest


def _edges(key: np.ndarray) -> np.ndarray:
    new = np.flatnonzero(np.diff(key) != 0) + 1
    return np.concatenate(([0], new, [len(key)]))


def _pairs_of(first: int, last: int, side: np.ndarray, most: int = 1 << 19):
    """Pairs (i < j) of a group's rows, in parts.  Sides 1 and 2 are those of two
    different blocks: only pairs across them, so none if one block is empty."""
    n = last - first
    apart = side[first:last].max() > 0
    if apart and (side[first:last] == side[first]).all():
        return
    rows = max(1, most // n)
    for r in range(0, n, rows):
        i, j = np.meshgrid(np.arange(r, min(r + rows, n)), np.arange(n), indexing="ij")
        ok = i < j
        i, j = i[ok] + first, j[ok] + first
        if apart:
            ok = side[i] != side[j]
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j


def _blocks(df: DataFrame, key: str, name: str, n_blocks: Column) -> DataFrame:
    """Deals the rows of each key into blocks and pairs of blocks.

    Adds ``name``, one number for (key, pair of blocks), and ``side`` (1 or 2 of
    a pair of different blocks, 0 in a block with itself)."""
    blocks = df.withColumn("_n", F.greatest(n_blocks, F.lit(1)).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_n")).cast("int"))
    paired = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    return paired.select(F.xxhash64(key, F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias(name), side.alias("side"), *df.columns)


class _Forest:
    """Labels of joined items, and which pairs joined them."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels.copy()
        self.pairs: list[tuple[int, int]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the items of every pair (i, j); keeps as many pairs as it takes."""
        a, b = self.labels[i], self.labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = np.flatnonzero(low != high)
        if not len(new):
            return
        width = int(self.labels.max()) + 1
        _, first = np.unique(low[new].astype(np.int64) * width + high[new], return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for k in new[first].tolist():
            x, y = find(int(low[k])), find(int(high[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.pairs.append((int(i[k]), int(j[k])))
        to = np.arange(width)
        for x in list(parent):
            to[x] = find(x)
        self.labels = to[self.labels]


# ---------------------------------------------------------------- the join


def _across(batches):
    """Pairs that join clusters which share a bucket and hold a surviving pair."""
    for edges, table in _groups(batches):
        side, nodes, clusters = (table.column(k).to_numpy() for k in (1, 2, 3))
        signs = _matrix(table.column(4).combine_chunks(), np.uint16, HASHES)
        out = []
        for first, last in zip(edges, edges[1:]):
            if last - first < 2 or (clusters[first:last] == clusters[first]).all():
                continue
            forest = _Forest(np.unique(clusters[first:last], return_inverse=True)[1])
            for i, j in _pairs_of(first, last, side):
                apart = forest.labels[i - first] != forest.labels[j - first]
                i, j = i[apart], j[apart]
                ok = survivors(signs, signs, i, j)
                forest.join(i[ok] - first, j[ok] - first)
            out += [(nodes[first + x], nodes[first + y]) for x, y in forest.pairs]
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(batches):
    """``a, b, links``: exact numbers of linked classes (of a; b is null), and
    verified pairs that join the linked classes of a block."""
    for edges, table in _groups(batches):
        side, nodes = (table.column(k).to_numpy() for k in (1, 2))
        signs = _matrix(table.column(3).combine_chunks(), np.uint16, HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in table.column(4).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        links = np.zeros(len(sets), np.int64)
        out = []
        for first, last in zip(edges, edges[1:]):
            forest = _Forest(np.arange(last - first))
            for i, j in _pairs_of(first, last, side):
                ok = survivors(signs, signs, i, j)
                i, j = i[ok], j[ok]
                if len(i):
                    ok = reaches(shared_counts(sets[first:last], i - first, j - first), sizes[i], sizes[j])
                    i, j = i[ok], j[ok]
                    links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
                    forest.join(i - first, j - first)
            out += [(nodes[first + x], nodes[first + y], None) for x, y in forest.pairs]
        out += [(nodes[x], None, links[x]) for x in np.flatnonzero(links)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "links"])


def _sorted_groups(df: DataFrame, key: str, *columns: str) -> DataFrame:
    # a fixed number of partitions: the work of a group grows with its square, so
    # tasks must not be merged by their bytes
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, "side", *columns).repartition(n, key).sortWithinPartitions(key)


def _numbered(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(classes with node, class, other)``: a number for every class, no two
    alike.  Almost all are a hash of the class; ``class, other`` lists those few
    whose hash another class has too (about n * n / 2**65 of n classes)."""
    hashed = classes.withColumn("node", F.xxhash64("class"))
    alike = hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("keeps")).where("n > 1")
    moved = store(hashed.join(alike, "node").where("class <> keeps").select("class", F.lit(0).cast("long").alias("other")), "moved")
    salt = 0
    while not moved.isEmpty():
        salt += 1
        moved_to = moved.select("class", F.xxhash64("class", F.lit(salt)).alias("other"))
        named = classes.join(moved_to, "class", "left").select("class", F.coalesce("other", F.xxhash64("class")).alias("node"))
        if named.groupBy("node").count().where("count > 1").isEmpty():
            moved = store(moved_to, "moved")
            break
    return _with_node(classes, moved), moved


def _with_node(df: DataFrame, moved: DataFrame) -> DataFrame:
    """Adds each class's number."""
    joined = df.join(moved, "class", "left") if not moved.isEmpty() else df.withColumn("other", F.lit(None).cast("long"))
    return joined.withColumn("node", F.coalesce("other", F.xxhash64("class"))).drop("other")


def join_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, groups)``: ``doc_id, class`` of every document that has a text,
    and ``class, first_id, group_id, is_head, n_links`` of every class (the head
    is the class that names its group)."""
    spark = docs.sparkSession
    ship(spark)
    named = _with_class(docs).where(F.col("class").isNotNull())
    ids = store(named.select("doc_id", "class"), "classes")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    firsts = store(ids.groupBy("class").agg(F.min(number).alias("first_number")), "firsts")
    firsts, moved = _numbered(firsts)
    named = _with_node(named, moved)

    signs = named.select("node", "text").mapInArrow(_signed, "node long, signature binary, bands array<long>")
    signs = store(signs.dropDuplicates(["node"]), "signatures")
    placed = signs.select("node", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    shared = store(placed.join(buckets, "bucket"), "buckets")
    signs = signs.select("node", "signature")
    release(spark)

    # clusters of candidates that survive the pruning
    one = lambda side: signs.select(F.col("node").alias(side), F.col("signature").alias(f"{side}_signature"))
    tried = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = tried.join(one("a"), "a").join(one("b"), "b").select("a", "b", "a_signature", "b_signature")
    joined = store(pairs.mapInArrow(_prune, "a long, b long"), "survivors")
    clusters = store(components(joined, "a", "b"), "clusters")
    grouped = shared.join(clusters, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("cluster"))
    grouped = store(grouped, "grouped")
    mixed = grouped.groupBy("bucket").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("bucket")
    dealt = _blocks(grouped.join(mixed, "bucket", "left_semi").join(signs, "node"), "bucket", "block", F.ceil(F.col("n") / BLOCK_CLASSES))
    more = store(_sorted_groups(dealt, "block", "node", "cluster", "signature").mapInArrow(_across, "a long, b long"), "survivors")
    if not more.isEmpty():
        clusters = store(components(clusters.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "a", "b"), "clusters")
    release(spark)

    # the texts of clustered classes, once each, as sets of shingles
    wanted = firsts.join(clusters.select("node"), "node").select("class", F.col("first_number").alias("number"))
    texts = named.withColumn("number", number).join(wanted, ["number", "class"], "left_semi").dropDuplicates(["number", "class"])
    sets = store(texts.select("node", "text").mapInArrow(_shingled, "node long, size long, shingles binary"), "shingles")
    release(spark)

    # exact links inside the clusters, and the groups that they make
    sized = clusters.join(sets.drop("size"), "node").join(signs, "node")
    total = clusters.join(sets.select("node", "size"), "node").groupBy("component").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("classes"))
    n_blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("classes") / BLOCK_CLASSES))
    dealt = _blocks(sized.join(total, "component"), "component", "block", n_blocks)
    linked = store(_sorted_groups(dealt, "block", "node", "signature", "shingles").mapInArrow(_linked, "a long, b long, links long"), "links")
    groups = store(components(linked.where("b is not null"), "a", "b"), "groups")
    n_links = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))

    heads = (
        firsts.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).join(n_links, "node", "left")
    )
    least = heads.groupBy("component").agg(F.min("first_number").alias("least"))
    named_heads = heads.join(least, "component").where("first_number = least").groupBy("component").agg(F.max("least").alias("least"), F.min("node").alias("head_node"))
    as_id = lambda c: F.when(c != _NO_ID, c).cast(docs.schema["doc_id"].dataType)
    out = heads.join(named_heads, "component")
    named_groups = store(
        out.select(
            "class",
            as_id(F.col("first_number")).alias("first_id"),
            as_id(F.col("least")).alias("group_id"),
            (F.col("node") == F.col("head_node")).alias("is_head"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ),
        "group-names",
    )
    discard(firsts, signs, shared, joined, grouped, more, sets, linked)
    return ids, named_groups


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links, copy_of`` of every document.

    ``class_id`` names its group of near duplicates, ``n_links`` is the number
    of different texts at the threshold or above, ``copy_of`` the first document
    with the same text."""
    ids, groups = join_classes(docs)
    with_text = ids.join(groups, "class").select("doc_id", F.col("group_id").alias("class_id"), "n_links", F.col("first_id").alias("copy_of"))
    without = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"))
    return with_text.unionByName(without)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its
    columns; documents without a text stay."""
    _, groups = join_classes(docs)
    id_of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NO_ID))
    heads = groups.where("is_head").select(id_of("group_id").alias("number"), "class")
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.where(F.col("text").isNotNull()).select(id_of("doc_id").alias("number"), F.unhex(F.md5(F.col("text").cast("string"))).alias("class"), *[F.col(c).alias(k) for c, k in names.items()])
    kept = keyed.join(heads, ["number", "class"], "left_semi").dropDuplicates(["number", "class"])
    return kept.select(*[F.col(k).alias(c) for c, k in names.items()]).unionByName(docs.where(F.col("text").isNull()))
