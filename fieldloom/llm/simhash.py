"""Operator 8, SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints: 64-bit majority votes over the XXH64 values (seed 42) of 4-word shingles. Covering
tables: each of the 64 bits has a non-zero vector of RADIUS + 1 bits; table t (one for each non-zero
vector) keeps the bits whose vector has odd product with t. Up to RADIUS differing bits span less
than the whole space, so some t is orthogonal to all of them: in its table the pair collides, always.

Exact copies meet first, in one row a fingerprint. Table rows whose masked value is alone are left
out. A bucket of up to CAP fingerprints is compared within itself and gives a star for each component of its
links, not all pairs. A larger bucket that lies within another large one has no pair of its own; the others
are dealt out once more, by the same construction over the bits that their mask ignored. Then a
bucket's fingerprints agree on all but DEEP_BITS bits at most, so by counting alone it fits a task,
whatever the data. Nothing is dropped. Links then meet in connected components.

Defined cases: null, empty and blank texts have fingerprint 0, and link with each other like any
other; component_id is the least non-null doc_id reachable, null where there is none; repeated rows
and ids give a row each; a very long text is hashed whole, in a step of its own; other columns are not read
or, by :func:`drop_near_duplicates`, kept, whatever their names; of documents with equal ids in a component
that of the least row hash stays, and of rows equal in all columns one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, byte_steps, table
from fieldloom.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that are compared within one task.
CAP = 2048
#: Bits that the masks of two deals leave free, at most.
DEEP_BITS = 17
_ALL = (1 << 64) - 1
_BATCH = 1 << 18  # hashes that meet in one step


def _hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    at, starts, ends = 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]


def _majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """Fingerprints of runs of ``counts`` hashes."""
    out = np.zeros(len(counts), np.uint64)
    n = np.array(counts, np.int64)
    full = np.flatnonzero(n)
    if len(full):
        h = np.array(hashes, np.uint64)
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for b in range(64):
            ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), starts).astype(np.int64)
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(b)
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        done, hashes, counts, column = [np.zeros(0, np.uint64)], [], [], batch.column("text")
        for lo, hi in byte_steps(column):
            for text in column.slice(lo, hi - lo).to_pylist():
                h = _hashes(text)
                hashes += h
                counts.append(len(h))
            if len(hashes) >= _BATCH or hi == len(column):
                done.append(_majority(hashes, counts))
                hashes, counts = [], []
        fp = pa.array(np.concatenate(done).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "text"] + [fp], [c for c in batch.schema.names if c != "text"] + ["fp"])


def fingerprints(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and fp, the 64 bits as a signed long."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["fp bigint"])
    return df.select(*keep, "text").mapInArrow(_fingerprint_batches, schema)


def covering_masks(bits: int = _ALL, radius: int = RADIUS) -> list[int]:
    """Masks over the set ``bits``: for any ``radius`` of them, some mask has none of those."""
    kinds = (1 << radius + 1) - 1
    own = [b for b in range(64) if bits >> b & 1]
    vector = {b: i % kinds + 1 for i, b in enumerate(own)}
    return [sum(1 << b for b in own if (vector[b] & t).bit_count() & 1) for t in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each component of the links among distinct fingerprints, its first one paired with every other; each is compared once, with those not reached yet."""
    a, b, left = [], [], np.arange(len(fps))
    while len(left):
        root, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            hit = (np.bitwise_count(fps[now][:, None] ^ fps[left][None, :]) <= radius).any(axis=0)
            new, left = left[hit], left[~hit]
            front = np.concatenate([front, new])
            a.append(np.full(len(new), fps[root]))
            b.append(fps[new])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _bucket_links(radius: int):
    """Of batches sorted by (table, masked), the links within each bucket."""

    def links(t, m, f):
        edges = np.flatnonzero((t[1:] != t[:-1]) | (m[1:] != m[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(t)]])
        two = starts[ends - starts == 2]
        a, b = f[two], f[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        parts = [(a[near], b[near])] + [_stars(f[s:e], radius) for s, e in zip(starts, ends) if e - s > 2]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = [np.asarray(batch.column(c)) for c in ("t", "masked", "fp")]
            if held:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if (now[0][0], now[1][0]) != (now[0][-1], now[1][-1]) else 0
            held = [x[last:] for x in now]
            if last:
                yield links(now[0][:last], now[1][:last], now[2][:last].view(np.uint64))
        if held and len(held[0]):
            yield links(held[0], held[1], held[2].view(np.uint64))

    return run


def deep_masks(radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(table, i, mask): covering masks over the bits that each table's mask leaves free."""
    out = [(t, i, m) for t, first in enumerate(covering_masks(radius=radius)) for i, m in enumerate(covering_masks(_ALL & ~first, radius))]
    return out


def _widest(hot: DataFrame, masks: DataFrame) -> DataFrame:
    """(t, masked) of the large buckets ``hot`` (t, masked, n, least, differs) that no other one holds: a bucket that agrees on another table's mask lies within a bucket of that table."""
    agrees = F.col("m").bitwiseAND(F.col("differs")) == 0
    held = hot.join(F.broadcast(masks.select(F.col("t").alias("other"), "m")), agrees & (F.col("t") != F.col("other")))  # a row a table and large bucket at most
    held = held.select("t", "masked", "n", "other", F.col("least").bitwiseAND(F.col("m")).alias("theirs"))
    by = hot.select(F.col("t").alias("other"), F.col("masked").alias("theirs"), F.col("n").alias("wider"))
    within = held.join(by, ["other", "theirs"]).filter((F.col("wider") > F.col("n")) | (F.col("other") < F.col("t"))).select("t", "masked").distinct()
    return hot.select("t", "masked").join(within, ["t", "masked"], "left_anti")


def near_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``: links whose components are those of all pairs within ``radius`` bits."""
    spark, first = distinct.sparkSession, [_signed(m) for m in covering_masks(radius=radius)]
    masks = spark.createDataFrame(list(enumerate(first)), "t int, m bigint")

    def linked(rows: DataFrame, buckets: DataFrame, name: str) -> DataFrame:
        dealt = rows.join(buckets, ["t", "masked"]).select("t", "masked", "fp").repartition("t", "masked").sortWithinPartitions("t", "masked", "fp")
        return scratch.save(dealt.mapInArrow(_bucket_links(radius), "a bigint, b bigint").distinct(), name)

    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("masked")) for t, m in enumerate(first)]
    rows = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.*")
    sizes = scratch.save(rows.groupBy("t", "masked").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    found = linked(rows, sizes.filter(F.col("n") <= cap).select("t", "masked"), "links")
    hot = sizes.filter(F.col("n") > cap)
    if hot.isEmpty():
        return found
    kinds = len(first)
    deeper = [(t, t * kinds + i, _signed(m)) for t, i, m in deep_masks(radius)]
    spread = rows.join(hot.select("t", "masked"), ["t", "masked"]).groupBy("t", "masked").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("differs"))
    wide = scratch.save(_widest(scratch.save(spread, "spread"), masks), "hot")
    table = F.broadcast(spark.createDataFrame(deeper, "t int, deep int, m bigint"))  # kinds * kinds rows
    again = rows.join(wide, ["t", "masked"]).join(table, "t").select(F.col("deep").alias("t"), F.col("masked").bitwiseOR(F.col("fp").bitwiseAND(F.col("m"))).alias("masked"), "fp")
    small = scratch.save(again.groupBy("t", "masked").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "masked"), "deep_buckets")
    return found.unionByName(linked(again, small, "deep_links")).distinct()


def cluster(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, anything) with component_id."""
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = near_links(distinct.select("fp"), scratch, radius)
    roots = components(links, scratch, "links_cc")
    groups = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = groups.join(names, "root").select("fp", "component_id")
    return prints.join(ids, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    scratch = Scratch(spark)
    prints = scratch.save(fingerprints(table(spark, sf_dir, "documents"), "doc_id"), "prints")
    return cluster(prints, scratch).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that of the least (doc_id, hash of the row) with null ids last; all columns as they came.

    Ids and fingerprints decide; a text moves only once, to meet the decision on its row's key.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    everything = [F.col(f"`{c}`") for c in names]
    keyed = docs.select(F.xxhash64(*everything).alias("_k1"), F.xxhash64(F.lit(SEED), *everything).alias("_k2"), F.col("doc_id").alias("_id"), F.col("text"))
    prints = scratch.save(fingerprints(keyed.withColumnRenamed("_id", "doc_id"), "_k1", "_k2", "doc_id"), "prints")
    # components need a name even where all ids are null: the least fingerprint serves
    distinct = scratch.save(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")).alias("best")), "distinct")
    roots = components(near_links(distinct.select("fp"), scratch, radius), scratch, "links_cc")
    groups = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("best", F.coalesce("root", "fp").alias("root"))
    kept = groups.groupBy("root").agg(F.min("best").alias("best")).select("best._k1", "best._k2")
    rows = docs.select(F.xxhash64(*everything).alias("_k1"), F.xxhash64(F.lit(SEED), *everything).alias("_k2"), F.struct(*everything).alias("_row"))
    one = rows.join(kept, ["_k1", "_k2"]).groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    return one.select("_row.*")
