"""Repeated runs of words, exactly, from a sparse selection of anchors: shared by operators 3 and 5.

A window is ``length`` consecutive words of one text. Its anchor is the leftmost least of the hashes
of its ``gram``-word runs, so equal windows have equal anchors at equal distances, and a text has one
anchor in about (length - gram) / 2 words. Consecutive windows with one anchor form a block. Then

* an anchor hash that occurs once proves its windows unique;
* one whose blocks are all equal (least and greatest block hash agree) proves all of them repeated;
* only what is left, around the ends of shared passages, is looked at window by window.

Hashes have 64 bits; a false repeat needs two different windows that agree in the anchor's hash and
in their own. Texts are told apart by (doc_id, hash of the text); rows equal in both are equal.

Defined cases: null and empty texts and those under ``length`` words have no window; a very long text
is a step of its own and held whole by one task; repeated rows give rows each; ids may be null; other
columns are not read, whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hash_runs, hash_spans, leftmost_minimum, mix, text_steps, word_bounds, word_sums

_GAP, _REACH = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _steps(column: pa.Array):
    """(first row, row of each word, their words' first index, number of words of each row, hashes of words) of each step."""
    for lo, hi, data, offsets in text_steps(column):
        starts, ends, row = word_bounds(data, offsets)
        counts = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, np.int64)
        yield lo, row, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, hash_spans(data, starts, ends)


def _blocks(length: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, ths = batch.column("doc_id"), batch.column("th")
            for lo, row, base, _, hashes in _steps(batch.column("text")):
                n, sums = len(row), word_sums(hashes)
                if n < length:
                    continue
                at = np.arange(n - gram + 1)
                grams = hash_runs(sums, at, at + gram)
                owner = leftmost_minimum(grams, length - gram + 1)
                s = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
                if not len(s):
                    continue
                o = owner[s]
                cut = np.flatnonzero((o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)) + 1
                first, last, p = s[np.concatenate([[0], cut])], s[np.concatenate([cut, [len(s)]]) - 1], o[np.concatenate([[0], cut])]
                block = mix(hash_runs(sums, first, last + length) + (last - first).astype(np.uint64) * _GAP + (p - first).astype(np.uint64) * _REACH)
                r = row[first]
                take = pa.array(lo + r)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), ths.take(take), pa.array((first - base[r]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((p - first).astype(np.int32)), pa.array(grams[p].view(np.int64)), pa.array(block.view(np.int64))],
                    ["doc_id", "th", "start", "n", "off", "anchor", "block"],
                )

    return run


def blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, th, start, n, off, anchor, block): windows ``start`` to ``start + n - 1`` of a text share an anchor, at word ``start + off``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(_blocks(length, gram), f"doc_id {kind}, th bigint, start int, n int, off int, anchor bigint, block bigint")


def summed(found: DataFrame) -> DataFrame:
    """(anchor, n, least, most) of blocks: what an index keeps of them."""
    return found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))


def repeated_anchors(index: DataFrame) -> DataFrame:
    return index.filter("n > 1").select("anchor", "n", (F.col("least") == F.col("most")).alias("whole"))


def _windows(length: int):
    def run(batches):
        for batch in batches:
            ids, ths, spans = batch.column("doc_id"), batch.column("th"), batch.column("spans")
            for lo, row, base, counts, hashes in _steps(batch.column("text")):
                sums, part = word_sums(hashes), spans.slice(lo, len(counts))
                flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
                r = np.repeat(np.arange(len(counts)), sizes)
                n = flat.field("n").to_numpy().astype(np.int64)
                r, s = np.repeat(r, n), np.repeat(flat.field("start").to_numpy().astype(np.int64), n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                anchor = np.repeat(flat.field("anchor").to_numpy(), n)
                if len(s):
                    take = pa.array(lo + r)
                    w = hash_runs(sums, base[r] + s, base[r] + s + length)
                    yield pa.RecordBatch.from_arrays([ids.take(take), ths.take(take), pa.array(s.astype(np.int32)), pa.array(anchor), pa.array(w.view(np.int64))], ["doc_id", "th", "start", "anchor", "w"])

    return run


def open_windows(docs: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, anchor, w) of the windows whose repetition is still open."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    per = hits.filter("NOT whole").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("spans"))
    texts = keyed(docs)
    both = texts.join(per, same_text(texts, per)).select(texts["doc_id"], texts["th"], "text", "spans")
    return both.mapInArrow(_windows(length), f"doc_id {kind}, th bigint, start int, anchor bigint, w bigint")


def spans_of(whole: DataFrame, single: DataFrame) -> DataFrame:
    """(doc_id, th, spans): runs of repeated windows of each text that has any."""
    every = whole.filter("whole").select("doc_id", "th", "start", "n").unionByName(single.select("doc_id", "th", "start", F.lit(1).alias("n")))
    return every.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
