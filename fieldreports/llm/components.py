"""Connected components of an edge table by alternating star steps.

A large-star step links every larger neighbour of a node to the smallest node of
its neighbourhood, a small-star step does so for the smaller ones; both keep the
components and end in stars around their smallest nodes after a number of rounds
that grows with the logarithm of the size.  Minima are partial aggregates and the
join back is an ordinary shuffled join, so a node with very many neighbours is
summed on the map side and split by the skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldreports.llm.common import discard, store

#: Edges in a partition: a small graph has one, and then needs no shuffle at all.
EDGES_PER_PARTITION = 100_000


def _sized(edges: DataFrame) -> DataFrame:
    """The edges in as many partitions as their number asks for."""
    return edges.coalesce(max(1, -(-edges.count() // EDGES_PER_PARTITION)))


def _rows(df: DataFrame, *rows: tuple[str, str]) -> DataFrame:
    """Several rows (u, v) of each one, in its own partition."""
    return df.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in rows])))


def _star(pairs: DataFrame) -> DataFrame:
    """Each row (u, v) becomes (u, v, m), m the smallest node around u, u included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """``node, component`` for every node that an edge touches; a component is
    named by its smallest node."""
    now = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        sized = _sized(now)
        if _are_stars(sized):
            break
        large = _star(_rows(sized, ("u", "v"), ("v", "u"))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _rows(_star(large), ("v", "m"), ("u", "m"))
        now, old = store(small.where("u <> v").distinct(), "edges"), now
        discard(old)
    else:
        raise RuntimeError(f"components are still changing after {rounds} rounds")
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one smaller neighbour at most, and is no node with one the
    smaller neighbour of another?"""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))))
    seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()
