"""Operator 3, suffix-array dedup over a sparse, distributed suffix array.

Only suffixes at minimiser positions are retained: those that start at the anchors of
``LENGTH``-word windows (see :mod:`fieldloom.llm.repeats`), chosen by content, so that any passage of
that many words that occurs twice has an anchor at the same place in both. Suffixes whose anchor
occurs once are dropped. The rest is put in order, and each is compared with its neighbours:

* ``right`` holds the words after the anchor, ``left`` those before it, the nearest first, as far as
  windows of this anchor reach; a word is 40 bits of its hash. Rows are sorted by (anchor, right, left),
  the order of the suffixes, by ranges that include the place, so that equal ones spread over tasks;
* the common prefix with a neighbour is the longest right extension there is, that of ``left``
  extends the match to the left. Where both together reach LENGTH words, the windows in between are
  repeated; where even the longest right extension is too short, a window is unique;
* a longer left extension may belong to a suffix farther away. Anchors with windows left open are sorted
  once more, by (anchor, left, right), which gives the longest left extension in the same way;
* windows that are still open (their longest extensions belong to different suffixes), and those of rows at the
  edge of a task, are compared whole, by hash, with the candidates of their anchor.

Suffixes of an anchor whose surroundings all agree (one fingerprint) are sorted without their words.

Defined cases: null, empty and short texts have no repeats; a repeat within one text counts, as do
overlapping ones; rows equal in id and text are different places, each reported; ids may be null; a very
long text is read whole by one task, and its suffixes spread like others; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import repeats
from fieldloom.llm.common import Scratch, join_counted, table

LENGTH, GRAM = 50, 12
#: Words that a window holds beside its anchor, and bytes of a word in ``right`` and ``left``.
REACH, WORD_BYTES = LENGTH - GRAM, 5
#: Suffixes of a range, about, and of one step of a text.
RANGE, STEP = 500_000, 20_000
_ROW = "th bigint, start int, n int, off int, anchor bigint, right binary, left binary"


def _packed(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: int) -> pa.Array:
    """Binary values of the words ``first``, ``first + step``, ... of each row, ``sizes`` of them."""
    ends = np.cumsum(sizes)
    at = np.repeat(first, sizes) + step * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes))
    raw = codes[at].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :].tobytes()
    offsets = np.concatenate([[0], ends * WORD_BYTES]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _suffixes(batches):
    for batch in batches:
        ids, ths, spans = batch.column("doc_id"), batch.column("th"), batch.column("spans")
        for lo, _, base, counts, hashes in repeats._steps(batch.column("text")):
            part = spans.slice(lo, len(counts))
            flat, codes = part.flatten(), hashes >> np.uint64(64 - 8 * WORD_BYTES)
            every = np.repeat(np.arange(len(counts)), np.diff(part.offsets.to_numpy()))
            start, n, off = (flat.field(c).to_numpy() for c in ("start", "n", "off"))
            for i in range(0, len(every), STEP):
                r, s, m, o = every[i : i + STEP], start[i : i + STEP].astype(np.int64), n[i : i + STEP].astype(np.int64), off[i : i + STEP].astype(np.int64)
                p, take = base[r] + s + o, pa.array(lo + r)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), ths.take(take), pa.array(s.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(o.astype(np.int32)), flat.field("anchor").slice(i, len(r)), _packed(codes, p + GRAM, m - 1 + REACH - o, 1), _packed(codes, p - 1, o, -1)],
                    ["doc_id", "th", "start", "n", "off", "anchor", "right", "left"],
                )


def suffixes(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, th, start, n, off, anchor, right, left, whole) of retained suffixes; words come from the texts where surroundings differ."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    per = hits.filter("NOT whole").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "off", "anchor")).alias("spans"))
    texts = repeats.keyed(docs)
    both = texts.join(per, repeats.same_text(texts, per)).select(texts["doc_id"], texts["th"], "text", "spans")
    some = both.mapInArrow(_suffixes, f"doc_id {kind}, {_ROW}").withColumn("whole", F.lit(False))
    none = F.lit(b"").alias("right"), F.lit(b"").alias("left")
    return some.unionByName(hits.filter("whole").select("doc_id", "th", "start", "n", "off", "anchor", *none, "whole"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, one a column, and how many there are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WORD_BYTES) if offsets[-1] > offsets[0] else np.zeros((0, WORD_BYTES), np.uint8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :WORD_BYTES] = raw
    sizes = np.diff(offsets) // WORD_BYTES
    out = np.zeros((len(sizes), REACH), np.uint64)
    out[np.arange(REACH)[None, :] < sizes[:, None]] = wide.view(np.uint64).ravel()
    return out, sizes


def _common(column: pa.Array) -> np.ndarray:
    """Number of leading words that each row but the first shares with the one before it."""
    words, sizes = _matrix(column)
    differs = words[1:] != words[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), REACH)
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def _bits(lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Masks with the bits ``lo`` to ``hi``, as far as they lie in 0 to ``n - 1``."""
    lo, hi = np.clip(lo, 0, 63), np.clip(np.minimum(hi, n - 1), -1, 62)
    one = np.int64(1)
    return np.where(lo <= hi, (one << (hi + 1)) - (one << lo), 0)


def _neighbours(rightwards: bool):
    """Of rows in order: ``mask`` of the windows that a neighbour repeats, ``open`` of those that the longest extension to this side allows. Holds back one row."""

    def out(t: pa.Table, lo: int, hi: int, opening: bool, closing: bool) -> pa.RecordBatch:
        """Rows lo to hi - 1 of ``t``; the one before and the one after, if any, are in ``t`` too."""
        anchor = t.column("anchor").to_numpy()
        same = anchor[1:] == anchor[:-1]
        n, off = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "off"))
        whole = t.column("whole").to_numpy(zero_copy_only=False)
        right, left = (np.where(same, _common(t.column(c)), -1) for c in ("right", "left"))
        mask, reach = np.zeros(t.num_rows, np.int64), np.full(t.num_rows, -1, np.int64)
        for rows in (slice(1, None), slice(None, -1)):  # each with the one before, and with the one after
            mask[rows] |= np.where(same, _bits(off[rows] - left, off[rows] - REACH + right, n[rows]), 0)
            reach[rows] = np.maximum(reach[rows], right if rightwards else left)
        edge = np.zeros(t.num_rows, bool)
        edge[0] |= opening
        edge[-1] |= closing
        reach[edge] = REACH  # what lies beyond the task's first and last row is not known here
        zero = np.zeros_like(off)
        may = _bits(zero, off - REACH + reach, n) if rightwards else _bits(off - reach, n - 1, n)
        may[reach < 0] = 0
        full = _bits(zero, n - 1, n)
        twin = np.zeros(t.num_rows, bool)  # an equal neighbour, here or, as there are two at least, beyond the edge
        twin[1:] |= same
        twin[:-1] |= same
        mask, may = np.where(whole, np.where(twin | edge, full, 0), mask), np.where(whole, 0, may)
        if not rightwards:
            mask, may = mask | t.column("mask").to_numpy(), may & t.column("open").to_numpy()
            t = t.drop_columns(["mask", "open"])
        t = t.append_column("mask", pa.array(mask)).append_column("open", pa.array(may))
        return t.slice(lo, hi - lo).combine_chunks().to_batches()[0]

    def run(batches):
        held, opening = None, True
        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                now = now if held is None else pa.concat_tables([held, now])
                n, lo = now.num_rows, 0 if held is None or held.num_rows == 1 and opening else 1
                if n - 1 > lo:
                    yield out(now, lo, n - 1, opening, False)
                    opening = False
                    held = now.slice(n - 2)  # the row before goes along
                else:
                    held = now
        if held is not None:
            yield out(held, held.num_rows - 1, held.num_rows, opening and held.num_rows == 1, True)

    return run


def _in_order(rows: DataFrame, rightwards: bool, parts: int) -> DataFrame:
    """``rows`` with ``mask`` and ``open`` from their neighbours in the order of suffixes, or of what comes before the anchors."""
    order = ["anchor", *(["right", "left"] if rightwards else ["left", "right"]), "doc_id", "th", "start"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_ROW}, whole boolean, mask bigint, open bigint"
    columns = ["doc_id", *(x.split()[0] for x in _ROW.split(", ")), "whole", *([] if rightwards else ["mask", "open"])]
    return rows.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(rightwards), schema)


def _window_hash(l: Column) -> Column:
    """Of the window with ``l`` words before its anchor."""
    return F.xxhash64("anchor", l, F.substring("left", F.lit(1), l * WORD_BYTES), F.substring("right", F.lit(1), (REACH - l) * WORD_BYTES))


def _unsure(rows: DataFrame) -> DataFrame:
    """(anchor, n, places) of anchors with open windows that no neighbour repeats: their candidates, and how many words before the anchor such windows begin."""
    places = F.expr("transform(filter(sequence(0, n - 1), i -> shiftright(open & ~mask, i) & 1 = 1), i -> off - i)")
    per = rows.filter("open <> 0").select("anchor", places.alias("l"))
    return per.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("l"))).alias("places")).filter("size(places) > 0")


def _settle(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, start, mask) of the windows still open that the candidates of their anchor repeat."""
    some = join_counted(rows.filter("open <> 0"), scratch.save(_unsure(rows), "unsettled"), ["anchor"], scratch, "hot_unsettled")
    each = some.withColumn("k", F.explode(F.expr("filter(sequence(0, n - 1), i -> shiftright(open, i) & 1 = 1 and array_contains(places, off - i))")))
    each = scratch.save(each.select("doc_id", "th", "start", "k", F.expr("shiftright(open & ~mask, k) & 1 = 1").alias("unsure"), "anchor", _window_hash(F.col("off") - F.col("k")).alias("w")), "whole_windows")
    counts = each.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = join_counted(each.filter("unsure"), counts, ["anchor", "w"], scratch, "hot_windows")
    return found.select("doc_id", "th", "start", F.expr("shiftleft(1L, k)").alias("mask"))


def _merge(batches):
    for batch in batches:
        row, first, last = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            end = -1
            for x in spans:
                for k in range(x["mask"].bit_length()):
                    if x["mask"] >> k & 1:
                        s = x["start"] + k
                        if s > end:
                            row.append(i)
                            first.append(s)
                            last.append(0)
                        end = last[-1] = s + LENGTH
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("copies").take(take), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "copies", "first_word", "end_word"])


def suffix_array(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, start, mask, own): for each retained suffix of each row, which windows of its anchor are repeated; ``own`` is 1 in one row a suffix."""
    found = scratch.save(repeats.blocks(docs, LENGTH, GRAM), "blocks")
    again = scratch.save(repeats.repeated_anchors(repeats.summed(found)), "repeated")
    hits = scratch.save(join_counted(found, again, ["anchor"], scratch, "hot_anchors").select("doc_id", "th", "start", "n", "off", "anchor", "whole"), "hits")
    total = again.agg(F.sum("n")).first()[0] or 0
    scratch.drop("blocks", "repeated", "hot_anchors")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    rows = scratch.save(suffixes(docs, hits), "suffixes")
    scratch.drop("hits")
    first = _in_order(rows, True, parts)
    words = [F.when(F.col("open") != 0, F.col(c)).otherwise(F.lit(b"")).alias(c) for c in ("right", "left")]  # of suffixes without an open window the words are done with
    first = scratch.save(first.select("doc_id", "th", "start", "n", "off", "anchor", *words, "whole", "mask", "open"), "first_order")
    scratch.drop("suffixes")
    unsure = scratch.save(_unsure(first), "unsure")
    second = scratch.save(join_counted(first.filter("open <> 0"), unsure, ["anchor"], scratch, "hot_unsure").drop("places"), "candidates")
    second = scratch.save(_in_order(second, False, parts), "second_order")
    parts_of = [first.select("doc_id", "th", "start", "mask", F.lit(1).alias("own"))]
    parts_of += [x.select("doc_id", "th", "start", "mask", F.lit(0).alias("own")) for x in (second, _settle(second, scratch))]
    return parts_of[0].unionByName(parts_of[1]).unionByName(parts_of[2])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word): maximal runs of words covered by passages of LENGTH words that occur elsewhere."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # equal rows meet in partial sums first, so a text's list is no longer than the text
    per = suffix_array(docs, scratch).groupBy("doc_id", "th", "start").agg(F.bit_or("mask").alias("mask"), F.sum("own").alias("copies")).filter("mask <> 0")
    spans = per.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "mask"))).alias("spans"), F.max("copies").cast("int").alias("copies"))
    runs = spans.select("doc_id", "copies", "spans").mapInArrow(_merge, f"doc_id {kind}, copies int, first_word bigint, end_word bigint")
    return runs.select("doc_id", "first_word", "end_word", F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(table(spark, sf_dir, "documents")).withColumn("n_words", F.col("end_word") - F.col("first_word"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT s.r, i, md5(array_to_string(w[i : i + {LENGTH - 1}], ' ')) AS k FROM s JOIN d USING (r)),
g AS (SELECT r, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
e AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS cut FROM g),
f AS (SELECT r, i, sum(cut) OVER (PARTITION BY r ORDER BY i) AS grp FROM e)
SELECT doc_id, min(i)::BIGINT - 1 AS first_word, max(i)::BIGINT - 1 + {LENGTH} AS end_word, (max(i) - min(i) + {LENGTH})::BIGINT AS n_words
FROM f JOIN d USING (r) GROUP BY r, doc_id, grp
"""
