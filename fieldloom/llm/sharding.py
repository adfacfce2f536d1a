"""Operator 1, sharding [native]: extendible hashing over a directory of hash-prefix bits.

Every row hashes to 60 bits (the head of an MD5 over its id and text). A bucket is a bit prefix;
only a bucket over the byte limit splits on its next bit. Because splitting an oversized bucket
never depends on its neighbours, the leaf of a row is the shortest prefix whose bucket fits, and
all leaves follow from one histogram of byte sums per prefix:

* the histogram is taken at a depth chosen from the total size, with map-side partial sums, so a
  hot bucket costs one row per task; sums of the shorter prefixes come from that histogram;
* a prefix that fits, while its parent (one key for two children) does not, is a leaf; a cell meets its leaf
  at the depths at which there are leaves: those of at most SHALLOW bits by a broadcast of at most
  2**(SHALLOW + 1) rows, deeper ones by keys that are as many as the prefixes of that depth;
* rows join their histogram cell, an equi-join on well-mixed bits, which cannot be skewed by a key;
* cells that are still oversized at that depth go on, alone, with eight more bits.

Defined cases: a null or empty text weighs 0 bytes; no row gives no shard; a very long text weighs what it
weighs, and one over the limit has a shard or page of its own; rows equal in id and text share all
60 bits, and where such a group alone passes the limit its copies go to overflow pages (``overflow`` 1,
2, ...), as many to a page as fit. Extra columns are kept, whatever their names; an added column whose name is
taken, in any case, has underscores after it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, fresh, table

BITS = 60
#: Bytes of text that a shard holds at most.
LIMIT = 1 << 20
#: Bits of the histogram beyond those that equal shards of the limit would need, and of each further round.
EXTRA_BITS, ROUND_BITS = 4, 8
#: Depth up to which leaves are broadcast.
SHALLOW = 10
ADDED = ("shard_id", "depth", "overflow", "shard_bytes", "shard_docs")


def key_bits(doc_id: Column, text: Column) -> Column:
    """60 well-mixed bits of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def leaves(cells: DataFrame, low: int, high: int, limit: int, scratch: Scratch, name: str) -> DataFrame:
    """(cell, depth, shard_bytes, shard_docs) of those ``cells`` (cell, b, n; of depth ``high``) that a prefix of ``low`` to ``high`` bits takes."""
    at = lambda depths: cells.select("cell", "b", "n", F.explode(depths).alias("depth")).withColumn("p", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = at(F.sequence(F.lit(low), F.lit(high))).groupBy("depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = scratch.save(sums.filter(F.col("shard_bytes") <= limit), f"{name}_fits")
    parent = fits.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("above"))
    found = scratch.save(fits.withColumn("above", F.expr("shiftright(p, 1)")).join(parent, ["depth", "above"], "left_anti").drop("above"), f"{name}_leaves")
    depths = sorted(r[0] for r in found.select("depth").distinct().collect())  # at most BITS + 1 numbers
    paths = at(F.array(*[F.lit(d) for d in depths]) if depths else F.expr("cast(array() as array<int>)")).drop("b", "n")
    near, far = F.col("depth") <= SHALLOW, F.col("depth") > SHALLOW
    both = paths.filter(near).join(F.broadcast(found.filter(near)), ["depth", "p"]).unionByName(paths.filter(far).join(found.filter(far), ["depth", "p"]))
    return both.select("cell", "depth", "shard_bytes", "shard_docs")


def shard(df: DataFrame, key: Column, size: Column, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with ``shard_id`` (bits, oldest first), ``depth``, ``overflow``, ``shard_bytes`` and ``shard_docs``; every shard and page holds at most ``limit`` bytes unless it is one row."""
    if limit < 1:
        raise ValueError("limit must be positive")
    scratch = scratch or Scratch(df.sparkSession)
    added = fresh(df, *ADDED)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_h"), size.cast("long").alias("_b"))
    total = rows.agg(F.sum("_b")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + EXTRA_BITS)
    parts, step = [], 0
    while True:
        placed = rows.withColumn("cell", F.expr(f"shiftright(_h, {BITS - high})"))
        cells = scratch.save(placed.groupBy("cell").agg(F.sum("_b").alias("b"), F.count(F.lit(1)).alias("n")), f"cells{step}")
        found = scratch.save(leaves(cells, low, high, limit, scratch, f"cells{step}"), f"found{step}")
        parts.append(placed.join(found, "cell").withColumn("overflow", F.lit(0).cast("long")))
        left = scratch.save(cells.select("cell").join(found.select("cell"), "cell", "left_anti"), f"left{step}")
        if left.isEmpty():
            break
        rows = placed.join(left, "cell", "left_semi").drop("cell")
        if high == BITS:
            parts.append(_overflow(rows, limit))
            break
        low, high, step = high + 1, min(BITS, high + ROUND_BITS), step + 1
    bits = F.expr(f"if(depth = 0, '', lpad(bin(shiftright(_h, {BITS} - depth)), depth, '0'))")
    out = [p.select("_row", bits.alias("shard_id"), "depth", "overflow", "shard_bytes", "shard_docs") for p in parts]
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole.select("_row.*", *[F.col(a).alias(b) for a, b in zip(ADDED, added)])


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of groups whose rows share all bits: equal rows are counted, then dealt out again in two steps, so that no task makes a whole group."""
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_b"), F.lit(1)))).cast("long")
    kinds = rows.groupBy("_row", "_h", "_b").agg(F.count(F.lit(1)).alias("copies"))
    pages = kinds.select("*", per.alias("per")).select("*", F.explode(F.expr("sequence(0L, (copies - 1) div per)")).alias("page")).repartition("_h", "page")
    here = F.expr("least(per, copies - page * per)")
    return (
        pages.withColumn("shard_docs", here).withColumn("shard_bytes", here * F.col("_b")).withColumn("cell", F.explode(F.expr("sequence(1L, shard_docs)")))
        .withColumn("overflow", F.col("page") + 1).withColumn("depth", F.lit(BITS))
    )


def directory(shards: DataFrame) -> DataFrame:
    """The directory in runs: the shard of the entries ``first`` to ``last``, which are prefixes of the greatest depth, as numbers. One row a shard, however deep."""
    leaf = shards.select("shard_id", "depth").distinct()
    depth = leaf.agg(F.max("depth").alias("global_depth"))  # one row
    own = F.expr("if(depth = 0, 0L, conv(shard_id, 2, 10)::bigint)")
    edge = lambda start: F.expr(f"shiftleft(own + {0 if start else 1}L, global_depth - depth)") - (0 if start else 1)
    return leaf.withColumn("own", own).join(F.broadcast(depth)).select(edge(True).alias("first"), edge(False).alias("last"), "global_depth", "shard_id")


def shard_documents(docs: DataFrame, limit: int = LIMIT, whole: bool = False) -> DataFrame:
    """Shards of documents: ids and sizes, or with ``whole`` all columns, to be written with ``partitionBy("shard_id")``."""
    key, size = key_bits(F.col("doc_id"), F.col("text")), F.coalesce(F.octet_length("text"), F.lit(0))
    if whole:
        return shard(docs, key, size, limit)
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.save(docs.select("doc_id", key.alias("key_bits"), size.cast("long").alias("n_bytes")), "narrow")
    return shard(narrow, F.col("key_bits"), F.col("n_bytes"), limit, scratch)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard at the production limit."""
    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard_id", "depth", "overflow", "shard_bytes", "shard_docs")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
n AS (
  SELECT k, h >> ({BITS} - k) AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, range(0, 41) r(k) GROUP BY ALL),
f AS (
  SELECT d.doc_id, d.h, d.n_bytes, min(k) AS depth FROM d JOIN n ON (d.h >> ({BITS} - n.k)) = n.p
  WHERE shard_bytes <= {LIMIT} GROUP BY ALL)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(f.h >> ({BITS} - f.depth)), f.depth::INT, '0') END AS shard_id,
       f.depth::INT AS depth, 0::BIGINT AS overflow, n.shard_bytes, n.shard_docs
FROM f JOIN n ON n.k = f.depth AND n.p = (f.h >> ({BITS} - f.depth))
"""
