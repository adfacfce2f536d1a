"""Operator 10, mixing sources to target weights by pivotal dependent rounding.

A source's documents share one fractional number of copies, target over size. The whole part is
taken; the fractions are rounded so that the words taken stay on target: two documents at a time,
mass moves from one to the other, by a seeded coin that keeps expectations, until one of the two is
integral. Moves keep the words of the pair constant, so a source ends within one document of its
target. Documents of a source are spread over buckets of bounded size, each bucket leaves at most one
fractional document, and those residuals meet in a reduction tree of fixed fan-in: the largest
source needs a few more levels, never one large task.

Targets follow from sums over the sources in an order; those are taken by ranges, so there may be as many
sources as hosts of a crawl.

Defined cases: a null text has 0 words; a very long text is one document of that size; documents of 0 words are rounded by their own coin, as they
carry no mass; a null source is a source of its own, the last; a source without words has target 0;
an empty table gives an empty result; equal rows are rounded together; ties in size are settled by the hash of
the row. :func:`mix_documents` keeps extra columns, whatever their names; the query doesn't read them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import Scratch, mix, n_words_of, table

#: Weights of the sources in code point order, repeating; share of all words to take; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = 17
#: Documents of a first-level bucket, about, and residuals that meet in a later one.
BUCKET, FAN_IN = 4_096, 64
_NEAR = 1e-9


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows before in ``order``: by ranges, then within a range. Sums that are exact don't hang on the ranges."""
    spark, keys = df.sparkSession, [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[o.alias(k) for o, k in zip(order, keys)], *[v.alias(f"_v_{n}") for n, v in sums.items()])
    rows = scratch.save(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    per = rows.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(n) for n in sums]).orderBy("_part").collect()  # a row a range
    kinds, at, table_ = {n: rows.schema[f"_v_{n}"].dataType.simpleString() for n in sums}, {n: 0 for n in sums}, []
    for r in per:
        table_.append((r["_part"], *(type(r[n])(at[n]) for n in sums)))
        at = {n: at[n] + r[n] for n in sums}
    below = spark.createDataFrame(table_, "_part int, " + ", ".join(f"_b_{n} {kinds[n]}" for n in sums))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(below), "_part")
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n) for n in sums])


def source_targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of rows (source, size, n): n equal documents of that size.

    Resharing the excess over the caps until none is left ends where every target is
    least(cap, level * weight) for one level; it follows from sums over the sources before, in the order of the
    level at which they reach their cap. Sums are of whole words and of weights.
    """
    per = scratch.save(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs")), "per_source")
    none = F.col("source").isNull()  # the last
    per = sums_before(per, [none, F.col("source")], {"rank": F.lit(1).cast("long")}, scratch, "ranked")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("at", F.col("cap") / F.col("w"))
    per = scratch.save(sums_before(per, [F.col("at"), none, F.col("source")], {"size_before": F.col("source_size"), "w_before": F.col("w")}, scratch, "by_level"), "levels")
    total, all_w = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float((total or 0) * share)) - most * F.col("size_before")) / (F.lit(float(all_w or 0)) - F.col("w_before"))
    # the first source in the order that does not reach its cap gives the level; of sources tied in ``at`` that is the highest level
    final = per.select("at", (-level).alias("below")).filter("-below <= at").agg(F.min(F.struct("at", "below"))["below"].alias("below")).first()
    target = F.col("cap") if final[0] is None else F.least(F.col("cap"), -final[0] * F.col("w"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _coin(key: int, level: int) -> float:
    return int(mix(np.array([(key ^ (SEED + 1000003 * level)) & (1 << 64) - 1], np.uint64))[0] >> np.uint64(11)) / float(1 << 53)


def pivot(p: list[float], size: list[int], key: list[int], level: int) -> tuple[np.ndarray, int]:
    """Rounded parts (0 or 1), and the index of the one left fractional in ``p`` or -1; ``p`` is worked on."""
    out = np.zeros(len(p), np.int64)
    held = -1
    coins = (mix(np.array(key, np.int64).view(np.uint64) ^ np.uint64(SEED + 1000003 * level)) >> np.uint64(11)) / float(1 << 53)
    for j in range(len(p)):
        if p[j] <= _NEAR or p[j] >= 1 - _NEAR:
            out[j] = round(p[j])
            continue
        if size[j] == 0:
            out[j] = coins[j] < p[j]
            continue
        if held < 0:
            held = j
            continue
        i, r = held, size[j] / size[held]
        up, down = min(1 - p[i], p[j] * r), min(p[i], (1 - p[j]) * r)
        move = up if coins[j] * (up + down) < down else -down
        p[i] += move
        p[j] -= move / r
        held = -1
        for k in (i, j):
            if p[k] <= _NEAR or p[k] >= 1 - _NEAR:
                out[k] = round(p[k])
            else:
                held = k
    return out, held


def _round(level: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        order, size = group["key"].to_numpy(), group["mass"].to_numpy()
        group = group.take(pa.array(np.lexsort((size, order))))
        p, size, key = group["part"].to_pylist(), group["mass"].to_pylist(), group["key"].to_pylist()
        out, held = pivot(p, size, key, level)
        settled = np.ones(len(p), bool)
        if held >= 0 and last:
            out[held] = _coin(key[held], level + 500) < p[held]
        elif held >= 0:
            settled[held] = False
        for name, values in (("part", pa.array(p, pa.float64())), ("settled", pa.array(settled)), ("copies", pa.array(group["whole"].to_numpy() + out, pa.int64()))):
            group = group.set_column(group.column_names.index(name), name, values)
        return group

    return run


def copies(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, size, key: long, n, anything else) with source_size, target and copies of the n equal documents together; ``key`` orders and seeds."""
    stats = scratch.save(source_targets(sizes, scratch, weights, share, most), "sources")
    rows = sizes.join(stats, sizes["source"].eqNullSafe(stats["source"]), "left").drop(stats["source"])
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n")
    x = F.when(F.abs(x - F.round(x)) < _NEAR, F.round(x)).otherwise(x)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET)).cast("long")
    rows = rows.withColumn("x", x).withColumn("whole", F.floor("x")).withColumn("part", F.col("x") - F.floor("x")).withColumn("mass", F.col("size"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(SEED)), buckets)).withColumn("settled", F.lit(False)).withColumn("copies", F.lit(0).cast("long")).drop("x")
    most_buckets = stats.agg(F.max(F.ceil(F.col("n_docs") / BUCKET))).first()[0] or 1
    levels = 1 + (math.ceil(math.log(most_buckets, FAN_IN) - 1e-12) if most_buckets > 1 else 0)
    settled = []
    for level in range(levels):
        done = rows.groupBy("source", "bucket").applyInArrow(_round(level, level == levels - 1), rows.schema)
        done = scratch.save(done, f"level{level}")
        settled.append(done.filter("settled"))
        rows = done.filter("NOT settled").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
    whole = settled[0]
    for s in settled[1:]:
        whole = whole.unionByName(s)
    return whole.drop("whole", "part", "mass", "bucket", "settled", "n_docs")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Rows equal in id, source and text are rounded together and share the outcome as evenly as whole copies allow."""
    scratch = Scratch(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", n_words_of(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "source", "text").alias("key"))
    sizes = scratch.save(rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    one = copies(sizes, scratch).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    one = one.withColumn("copies", F.expr("copies div n + if(i < copies % n, 1, 0)"))
    return one.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns as they came.

    Rows equal in all columns are counted before texts move (partial sums on the map side), so a
    group of copies costs one row; what they take together is dealt out again at the end.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    everything = [F.col(f"`{c}`") for c in names]
    k1, k2 = F.xxhash64(*everything), F.xxhash64(F.lit(SEED), *everything)
    rows = docs.select(F.col("source"), n_words_of(F.col("text")).alias("size"), k1.alias("key"), k2.alias("key2"))
    sizes = scratch.save(rows.groupBy("source", "size", "key", "key2").agg(F.count(F.lit(1)).alias("n")), "sizes")
    taken = copies(sizes, scratch, weights, share, most).filter("copies > 0").select("key", "key2", "copies")
    rows = docs.select(k1.alias("key"), k2.alias("key2"), F.struct(*everything).alias("_row")).groupBy("key", "key2").agg(F.first("_row").alias("_row"))
    return rows.join(taken, ["key", "key2"]).select("_row", F.explode(F.expr("sequence(1L, copies)"))).select("_row.*")
