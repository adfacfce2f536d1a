"""Connected components of an edge table, by alternating large-star and small-star rounds.

Defined cases: loops and repeated edges count once; a node of a loop alone is no node of the result; a node with
any number of edges is joined apart from the rest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, join_counted


def _star(pairs: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """``pairs`` (u, v): each u with neighbours v. Links v to the least of u's neighbourhood; v beyond u only, or u's own and all up to u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
    least = scratch.save(least, f"{name}_least")
    linked = join_counted(pairs, least, ["u"], scratch, f"{name}_hot")  # the centre of a large star is one key
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("m < u").select("u", F.col("m").alias("v"))
    return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), two columns of one ordered type; root is the least node of the component.

    Minima are partial sums on the map side; rows of a node with many edges stay where they are and
    meet its minimum by a broadcast of bounded size. Each round is written, so lineage stays short, and
    only a few numbers of a round reach the driver.
    """
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    mark = None
    for i in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = scratch.save(_star(both, True, scratch, f"{name}{i}_large").distinct(), f"{name}{i}_big")
        now, old = scratch.save(_star(big, False, scratch, f"{name}{i}_small").distinct(), f"{name}{i}"), mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}{i - 1}", *[f"{name}{i}_{x}" for x in ("big", "large_least", "large_hot", "small_least", "small_hot")])
        if mark == old:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
