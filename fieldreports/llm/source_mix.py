"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words of the mix are dealt in blocks of equal size.  The blocks go to the
sources by highest quotients ``target / (2 k + 1)``, then inside each source to
its shards (groups of documents by a seeded hash of id and text) in the same way, which gives every
shard an integer quota.  In a shard the documents lie end to end in a seeded
order and are cut into blocks; a quota takes whole passes over all blocks first
and then the blocks that follow a seeded one, around the end.  As the order of
the documents is random, so is the selection, and at most two documents of a
shard are taken in part.

Only DataFrame operations are used.  Windows run over one row per source, over
one row per shard of a source, and over the documents of one shard, which has a
bounded number of words; a hot source just has more shards, and so has a hot id.
Only rows that are equal in id and text share a shard, however many they are.

Defined results: a null text has size 0 and is never taken; documents without a
source form one source, the last; a source without words has target 0; an empty
table gives an empty table; repeated rows count one by one; equal quotients go
to the first source (shard); a very long text is counted whole, in one row;
columns of the input keep their names and values, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldreports.llm.common import store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST_REPEATS = 2
BLOCK_WORDS = 16
SHARD_WORDS = 500_000
SEED = 20


def with_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, digest``: the number of words of the whole text, and
    a hash of it, which tells rows of one id apart."""
    return docs.select("doc_id", "source", with_size(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` (words): shares by weight, no target above
    ``most`` times its source, the excess shared out again by weight.

    Sources are ordered by how early they fill up; each is full exactly if the
    level that remains once all earlier ones are full reaches its own limit.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    fills = Window.orderBy("limit", F.asc_nulls_last("source"))
    earlier = fills.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.lit(list(weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("limit", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("full", F.col("level") >= F.col("limit"))
        .withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))
    )


def sainte_lague(rows: DataFrame, group: list[str], item: list[Column], votes: str, seats: str, quota: str) -> DataFrame:
    """Adds ``quota``: the seats of each row of a group by highest quotients ``votes / (2 k + 1)``.

    Rounding the exact share gives all but a few seats.  The seats that are
    missing (or too many) lie among the next (last) ``share * rows / (2 seats) + 1``
    quotients of each row, so only those are ranked: at most 2.5 per row.
    """
    per = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    exact = F.when((F.sum(votes).over(per) > 0) & (F.col(seats) > 0), F.col(votes) * F.col(seats) / F.sum(votes).over(per)).otherwise(F.lit(0.0))
    rounded = (
        rows.withColumn("_exact", exact)
        .withColumn("_floor", F.floor(F.col("_exact") + 0.5))
        .withColumn("_open", F.when(F.sum("_exact").over(per) > 0, F.col(seats) - F.sum("_floor").over(per)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_near", F.when(F.col("_open") != 0, F.ceil(F.col("_exact") * F.count(F.lit(1)).over(per) / (2 * F.col(seats))) + 1).otherwise(F.lit(0)).cast("long"))
    )
    tried = rounded.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_near"))))
    k = F.when(F.col("_open") > 0, F.col("_floor") + F.col("_i") - 1).otherwise(F.col("_floor") - F.col("_i"))
    sign = F.signum("_open")
    usable = (F.col("_i") > 0) & (F.col("_k") >= 0) & (F.col(votes) > 0)
    best = Window.partitionBy(*group, F.col("_usable")).orderBy(F.col("_quotient") * -sign, *item, "_i")
    seated = (
        tried.withColumn("_k", k)
        .withColumn("_usable", usable)
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(best))
        .withColumn("_won", (F.col("_usable") & (F.col("_rank") <= F.abs("_open"))).cast("long"))
    )
    return seated.groupBy(*rows.columns).agg((F.max("_floor") + F.sum(F.col("_won") * sign)).cast("long").alias(quota))


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat(F.lit("s"), "source")).fillna({"key": "null"})


def _placed(docs: DataFrame, rows: DataFrame, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """``rows`` (``doc_id, source, size, digest`` and others) with ``source_size, target``
    and what is taken: ``passes`` whole ones, and the words ``[from1, to1)`` and
    ``[from2, to2)`` counted from the first word of the document."""
    block = F.lit(block_words)
    wanted = targets(docs)
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    sources = sainte_lague(wanted.withColumn("seats", seats), [], [F.asc_nulls_last("source")], "target", "seats", "blocks")
    sources = store(_key(sources).select("key", "source_size", "target", "blocks"), "sources")

    def deal(df: DataFrame) -> DataFrame:
        shards_of = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
        return _key(df).join(sources, "key").withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), shards_of))

    shards = deal(docs).groupBy("key", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, ["key", "blocks"], [F.col("shard")], "shard_size", "blocks", "quota")
    quota = F.least(F.col("quota"), MOST_REPEATS * F.col("n"))
    some = lambda c: F.when(F.col("n") > 0, c).otherwise(F.lit(0)).cast("long")
    shards = store(
        shards.withColumn("n", F.ceil(F.col("shard_size") / block))
        .withColumn("quota", quota)
        .select(
            "key",
            "shard",
            some(F.floor(F.col("quota") / F.col("n"))).alias("passes"),
            some(F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.col("n")) * block).alias("begin"),
            some((F.col("quota") % F.col("n")) * block).alias("length"),
            (F.col("n") * block).alias("round"),
        ),
        "shards",
    )
    line = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", "digest", F.lit(seed + 1)), "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = deal(rows).withColumn("start", F.sum("size").over(line) - F.col("size")).join(shards, ["key", "shard"])
    inside = lambda c: F.least(F.greatest(c - F.col("start"), F.lit(0)), F.col("size")).cast("long")
    stop = F.col("begin") + F.col("length")
    return placed.select(
        *rows.columns,
        "source_size",
        "target",
        "passes",
        inside(F.col("begin")).alias("from1"),
        inside(F.least(stop, F.col("round"))).alias("to1"),
        inside(F.lit(0)).alias("from2"),
        inside(F.greatest(stop - F.col("round"), F.lit(0))).alias("to2"),
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document."""
    sized = store(with_sizes(docs), "sizes")
    part = F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    taken = F.col("passes") * F.col("size") + part
    return _placed(sized, sized, block_words, shard_words, seed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, with their columns: one row for every whole
    pass, and one for a part, its words joined by single spaces (``n_chars``, if
    there, is then its length).  A whole document keeps its text as it is."""
    sized = store(with_sizes(docs), "sizes")
    kept = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "source", with_size(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"), *[F.col(c).alias(k) for c, k in kept.items()])
    placed = _placed(sized, rows, block_words, shard_words, seed)
    text = F.col(kept["text"])
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    first, second = F.col("to1") - F.col("from1"), F.col("to2") - F.col("from2")
    cut = F.array_join(F.concat(F.slice(words, F.col("from1").cast("int") + 1, first.cast("int")), F.slice(words, F.col("from2").cast("int") + 1, second.cast("int"))), " ")
    whole = first + second >= F.col("size")
    copies = F.array_repeat(text, F.col("passes").cast("int"))
    part = F.when(first + second == 0, F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(F.array(cut))
    out = placed.where("size > 0").withColumn("mixed", F.explode(F.concat(copies, part)))
    cols = {c: F.col(k) for c, k in kept.items()} | {"text": F.col("mixed")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("mixed") == text, F.col(kept["n_chars"])).otherwise(F.length("mixed")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in cols.items()])
