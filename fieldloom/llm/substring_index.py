"""Operator 5, substring dedup over a log-structured fingerprint index.

The index holds, for every anchor hash of the windows seen (see :mod:`fieldloom.llm.repeats`), how
often it occurred and the bounds of its block hashes. It grows by immutable runs, one a batch, each
a table bucketed and sorted by the hash. Documents come in batches, one after the other:

* a batch's anchors are merge-joined with every run, sorted buckets with sorted buckets, without a
  shuffle of the history; what comes out is how often each has been seen by now, this batch included;
* then the batch becomes a run. Two runs of one level are compacted, by a merge join too, before the
  next batch comes, so a fingerprint is rewritten a logarithmic number of times.

An anchor's state at the last batch that has it is its state for good. Anchors seen twice or more are
candidates: the windows around them are verified on the texts, and covered words go. Runs stay in the
index's folder under a manifest, and :meth:`FingerprintIndex.open` takes them up again.

Defined cases: a null text has no words and the digest of the empty text; texts shorter than a
window lose nothing; a repeat within one text counts, as do overlapping ones; rows equal in id and
text are different places, so all their windows go; ids may be null; a very long text is handled
alone by one task; other columns are not read, whatever their names; an empty table gives an empty
result and an empty run.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import repeats
from fieldloom.llm.common import Scratch, join_counted, table, text_steps, word_bounds

WINDOW, GRAM = 35, 10
#: Batches in which the query feeds its table to the index: the third finds the first two compacted.
BATCHES = 3
_RUN = "anchor bigint, n bigint, least bigint, most bigint"


class FingerprintIndex:
    """Sorted immutable runs of (anchor, n, least, most) under one folder; ``buckets`` is fixed for its life."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[tuple[str, int]] = []  # (table, level), the oldest first
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index that an earlier session left in the folder."""
        index = cls(spark, root)
        path, fs = index._path(f"{index.root}/manifest-*/_SUCCESS")
        found = sorted(str(x.getPath().getParent().getName()) for x in fs.globStatus(path) or [])
        if not found:
            raise ValueError(f"no index in {root}")
        index.version = int(found[-1].removeprefix("manifest-"))
        for r in spark.read.schema("at int, name string, level int, buckets int").json(f"{index.root}/{found[-1]}").orderBy("at").collect():  # a row a run
            index.buckets = r["buckets"]
            if r["name"]:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} ({_RUN}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {r['buckets']} BUCKETS LOCATION '{index.root}/{r['name']}'")
                index.runs.append((r["name"], r["level"]))
        return index

    def _path(self, name: str):
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(conf)

    def _write(self, rows: DataFrame, level: int) -> tuple[str, int]:
        name = f"fieldloom_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name, level

    def _commit(self, runs: list[tuple[str, int]]) -> None:
        """Make ``runs`` the index. The manifest comes last, so a run that died leaves the state before it."""
        gone = [name for name, _ in self.runs if name not in {n for n, _ in runs}]
        self.version += 1
        rows = [(i, name, level, self.buckets) for i, (name, level) in enumerate(runs)] or [(0, None, 0, self.buckets)]
        self.spark.createDataFrame(rows, "at int, name string, level int, buckets int").coalesce(1).write.json(f"{self.root}/manifest-{self.version:09d}")
        self.runs = runs
        for name in gone:
            self.spark.sql(f"DROP TABLE {name}")
            path, fs = self._path(f"{self.root}/{name}")
            fs.delete(path, True)

    def seen(self, sums: DataFrame) -> DataFrame:
        """(anchor, n, least, most) of a batch's anchors (``sums``), with what every run knows of them."""
        out = sums.select("anchor", "n", "least", "most")
        for name, _ in self.runs:
            old = self.spark.table(name).select("anchor", *[F.col(c).alias(f"old_{c}") for c in ("n", "least", "most")])
            out = out.join(old.hint("merge"), "anchor", "left").select("anchor", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.least("least", "old_least").alias("least"), F.greatest("most", "old_most").alias("most"))
        return out

    def append(self, sums: DataFrame) -> None:
        """Add a batch's anchors as a run."""
        self._commit([*self.runs, self._write(sums.select("anchor", "n", "least", "most"), 0)])

    def compact(self) -> None:
        """Merge the last two runs as long as they are of one level."""
        while len(self.runs) > 1 and self.runs[-1][1] == self.runs[-2][1]:
            (a, level), (b, _) = self.runs[-2:]
            x, y = self.spark.table(a).alias("x"), self.spark.table(b).alias("y")
            both = x.join(y.hint("merge"), F.col("x.anchor") == F.col("y.anchor"), "full")
            zero = F.lit(0).cast("long")
            merged = both.select(F.coalesce("x.anchor", "y.anchor").alias("anchor"), (F.coalesce("x.n", zero) + F.coalesce("y.n", zero)).alias("n"), F.least("x.least", "y.least").alias("least"), F.greatest("x.most", "y.most").alias("most"))
            self._commit([*self.runs[:-2], self._write(merged, level + 1)])

    def feed(self, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Take a batch's blocks in; (anchor, n, least, most) of its anchors as they stand with it."""
        self.compact()
        sums = scratch.save(repeats.summed(found), f"{name}_sums")
        seen = scratch.save(self.seen(sums).filter("n > 1"), f"{name}_seen")
        self.append(sums)
        scratch.drop(f"{name}_sums")
        return seen

    def drop(self) -> None:
        """Delete runs, manifests and folder."""
        for name, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []
        path, fs = self._path(self.root)
        fs.delete(path, True)


def _cut(batches):
    for batch in batches:
        spans = batch.column("spans")
        for lo, hi, data, offsets in text_steps(batch.column("text")):
            starts, ends, row = word_bounds(data, offsets)
            n_words = np.bincount(row, minlength=hi - lo)
            base = np.cumsum(n_words) - n_words
            part = spans.slice(lo, hi - lo)
            flat, sizes = part.flatten(), pc.fill_null(pc.list_value_length(part), 0).to_numpy()
            first = np.repeat(base, sizes) + flat.field("start").to_numpy()
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, first, 1)
            np.add.at(gone, first + flat.field("n").to_numpy() - 1 + WINDOW, -1)
            stays = np.cumsum(gone)[:-1] == 0
            starts, ends, row = starts[stays], ends[stays], row[stays]
            space = np.zeros(len(row), bool)
            space[:-1] = row[1:] == row[:-1]
            edge = np.zeros(len(data) + 1, np.int8)  # words do not touch, so each place opens or closes one at most
            edge[starts] = 1
            edge[ends] -= 1
            size = ends - starts + space
            last = np.cumsum(size)
            out = np.full(last[-1] if len(last) else 0, 0x20, np.uint8)
            letter = np.ones(len(out), bool)
            letter[last[space] - 1] = False
            out[letter] = data[np.cumsum(edge[:-1]) > 0]
            kept = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=hi - lo).astype(np.int64))])
            text = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_words - np.bincount(row, minlength=hi - lo), pa.int64()), text.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row: words in windows that occur elsewhere are gone.

    Rows are fed to the index in ``batches``, by a hash of the text. Without an ``index`` there is a new one, which
    goes with the call. With one, windows that the batches before held count too; ``history`` is their documents, whose
    texts verify what the fingerprints leave open, and the index keeps what this call feeds to it.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    if index is not None and index.runs and history is None:
        raise ValueError("an index with runs needs the documents it has seen")
    own = index or FingerprintIndex(spark, f"{scratch.root}/index")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeats.blocks(docs, WINDOW, GRAM).withColumn("batch", F.pmod(F.col("th"), F.lit(batches)).cast("int")).drop("off")
    found = scratch.save(found, "blocks", "batch")
    seen = None
    for b in range(batches):
        now = own.feed(found.filter(F.col("batch") == b), scratch, f"batch{b}")
        seen = now if seen is None else seen.unionByName(now)
    last = seen.groupBy("anchor").agg(F.max("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    again = scratch.save(repeats.repeated_anchors(last), "repeated")
    scratch.drop(*[f"batch{b}_seen" for b in range(batches)])
    if index is None:
        own.drop()
    hits = scratch.save(join_counted(found, again, ["anchor"], scratch, "hot_anchors").select("doc_id", "th", "start", "n", "anchor", "whole"), "hits")
    windows = scratch.save(repeats.open_windows(docs, hits, WINDOW), "windows")
    every = windows.select("anchor", "w")
    if history is not None:
        known = repeats.blocks(history, WINDOW, GRAM).join(again.filter("NOT whole").select("anchor", "whole"), "anchor")
        every = every.unionByName(repeats.open_windows(history, scratch.save(known.drop("off", "block"), "known"), WINDOW).select("anchor", "w"))
    scratch.drop("blocks", "hot_anchors")
    twice = scratch.save(every.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    verified = join_counted(windows, twice, ["anchor", "w"], scratch, "hot_windows").select("doc_id", "th", "start")
    spans = scratch.save(repeats.spans_of(hits, verified), "spans")
    scratch.drop("windows", "hits", "twice", "repeated", "hot_windows", "known")
    texts = repeats.keyed(docs)
    both = texts.join(spans, repeats.same_text(texts, spans), "left").select(texts["doc_id"], "text", "spans")
    return both.mapInArrow(_cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")


def op5_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps, by digest."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT s.r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k FROM s JOIN d USING (r)),
g AS (SELECT r, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + o AS p FROM g, range(0, {WINDOW}) t(o)),
x AS (SELECT d.r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
