"""Helpers shared by the corpus operators: table access, scratch storage, byte-level text arrays.

Words are maximal runs of code points outside ``[\\x20\\x09-\\x0D]`` everywhere; a null text has none.
"""

from __future__ import annotations

import uuid
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separator class of every word rule here, as a Java regular expression.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; a longer single text is handled alone.
STEP_BYTES = 1 << 20
#: Share of all rows, and rows at least, from which on a key is joined apart.
HOT, HOT_ROWS = 1000, 1000
#: Bytes of a split of a table's files, by default.
SPLIT_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is stored in fewer files than there are cores and holds less than a split of the default size for each.

    Such a file is often one row group, which one task reads whatever the number of splits; larger
    tables stay as they are, so what moves here never grows beyond a split a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPLIT_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def words_of(text: Column) -> Column:
    """Words as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without keeping them: separators are squeezed to one and trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SEPARATORS}|{SEPARATORS}$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SEPARATORS))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often and deep in lambdas it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        while s.lower() in taken:
            s += "_"
        taken.add(s.lower())
        out.append(s)
    return out


class Scratch:
    """Intermediate tables as Parquet in the shared folder that ``spark.checkpoint.dir`` names.

    Each table is written once and reread, which cuts lineage: a lost executor costs the tasks of
    the running stage, never the stages before. Only a local session may lack the setting.
    The folder goes with :meth:`close`, or at last when the driver ends.
    """

    #: Those not closed yet, the oldest first.
    live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file:///tmp/checkpoints"
        self.root = f"{base.rstrip('/')}/fieldloom-{uuid.uuid4().hex}"
        path, fs = self._path(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        Scratch.live.append(self)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def close(self) -> None:
        """Delete all tables; nothing may read them any more."""
        path, fs = self._path(self.root)
        fs.delete(path, True)
        if self in Scratch.live:
            Scratch.live.remove(self)

    @classmethod
    def close_since(cls, n: int) -> None:
        """Close what was opened after the first ``n`` live ones."""
        for scratch in cls.live[n:]:
            scratch.close()

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``df`` written and reread; in a folder for each value of ``by``, of which there should be few."""
        path = f"{self.root}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark free their shuffle files."""
        for name in names:
            path, fs = self._path(f"{self.root}/{name}")
            fs.delete(path, True)


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` joined with ``counts`` (keys, n, anything), a row for each key with ``n``, how many of ``rows`` have it.

    A key with a HOT-th of all counted rows or more would fill one task; there are at most HOT such
    keys, whatever the data, so their rows stay where they are and meet them by a broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    extra = [c for c in counts.columns if c not in keys and c != "n"]
    own = counts.select(*keys, F.col("n").alias("_n"), *extra)
    hot = scratch.save(own.filter(F.col("_n") * HOT >= max(total, HOT * HOT_ROWS)), name).drop("_n")  # at most HOT rows
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(own.drop("_n"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


# --- byte-level arrays -------------------------------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0x9E3779B97F4A7C15 | 1  # multiplier of the polynomial over bytes, odd and so invertible mod 2**64
_M = 0xD1342543DE82EF95  # and of that over words
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & _MASK
    return out


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), _powers(base, 1), _powers(1, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_R), _Powers(_M)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_steps(column: pa.Array, most: int = STEP_BYTES):
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_steps(column: pa.Array, most: int = STEP_BYTES):
    """(first row, last row + 1) of runs of rows of about ``most`` bytes of text or binary; a longer one is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the row of each."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SEP[data], out=inside[:n])
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    last = inside[:n] & ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    up, down = _BYTES.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``hash_runs`` takes the hash of any run of words."""
    up, _ = _WORDS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def hash_runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _WORDS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least of ``values[i : i + width]`` for each i that has so many."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(values)), 1
    pick = lambda a, b: np.where(values[b] < values[a], b, a)
    while size * 2 <= width:
        best = pick(best[: len(best) - size], best[size:])
        size *= 2
    rest = width - size
    return pick(best[:n], best[rest : rest + n]) if rest else best[:n]
