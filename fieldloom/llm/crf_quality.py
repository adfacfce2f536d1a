"""Operator 2, quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features (below) and those of the lines before and after it give an
emission score, a 2 x 2 table scores transitions, and forward-backward gives each line's marginal
probability of good. Marginals are averaged over a document, weighted by length; the score is the
probability of a good document that a logistic curve over that average, fitted to the labels, gives.

Labels are of documents, those of lines are latent: all lines of a good document are good, and a bad
one has at least one bad line. Fitting alternates between both (TURNS): lines are first judged each
by its own features, without neighbours, so that the clean lines of a bad document are told from its
bad ones; then the field is fitted to the lines' labels, and judges the lines of bad documents again.
It is fitted on at most SAMPLE labelled documents, the first by a hash of the id, and a run of at
most LINES consecutive lines of each, at a place chosen by a hash of the text. Only rows
whose crc32(doc_id) mod 4 is not 2 are learnt from; ids, language, source and labels never enter a score.

Defined cases: a text without words counts as one empty line, so it has a score too; null is empty;
a very long text is scored whole, in a step of its own; several labels of a document are averaged, a
tie is good; rows of one id and other texts are each learnt from, within SAMPLE; without labelled rows
of both kinds the score is the share of good ones known, or 0.5; every row is scored, repeated ones
alike; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import hash_runs, hash_spans, mix, table, text_steps, word_bounds, word_sums

SAMPLE, LINES = 2000, 128
#: Times that lines are judged again and the field is fitted to them.
TURNS = 3
THRESHOLD = 0.7
HELD_OUT = 2
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
GRAM = 5
FEATURES = (
    "log bytes", "log words", "word length", "upper", "all upper", "symbols", "many symbols", "digits", "exclaims", "dashes and bars",
    "same as last word", "many same", "known words", "few distinct", "repeated runs", "many repeated runs", "repeated line", "ended", "opened", "short",
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("0123456789")
_LOWER[0xC3:] = True
_SYMBOL, _EXCLAIM, _BAR, _END = _mask("#*$%&|<>=~^_{}\\@+"), _mask("!"), _mask("|-_/"), _mask(".!?:;\"')")


def _share_repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs more than once, is not the first occurrence) of each key."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return counts[inverse] > 1, first[inverse] != np.arange(len(keys))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, weight (bytes) and features of each line that has a word; rows without any have one empty line."""
    rows = len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets)
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.unique(np.concatenate([offsets, breaks]))
    lo, hi = edges[:-1], edges[1:]
    line = np.searchsorted(lo, starts, "right") - 1
    n_words = np.bincount(line, minlength=len(lo))
    words = len(starts)
    hashes = hash_spans(data, starts, ends)
    sums = word_sums(hashes)
    in_row, in_line = row.astype(np.uint64) << np.uint64(40), line.astype(np.uint64) << np.uint64(40)
    per_line = lambda flags: np.bincount(line, weights=flags, minlength=len(lo))
    same = np.zeros(words, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    again = _share_repeated(mix(hashes ^ mix(in_line)))[1]
    covered = np.zeros(words + GRAM, np.int32)
    if words >= GRAM:
        at = np.flatnonzero(row[: words - GRAM + 1] == row[GRAM - 1 :])
        twice = at[_share_repeated(mix(hash_runs(sums, at, at + GRAM) ^ mix(in_row[at])))[0]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + GRAM, -1)
    covered = np.cumsum(covered)[:words] > 0
    real = n_words > 0
    first = np.searchsorted(line, np.arange(len(lo)))
    line_hash = hash_runs(sums, first, first + n_words)
    line_row = np.searchsorted(offsets, lo, "right") - 1
    line_again = np.zeros(len(lo), bool)
    line_again[real] = _share_repeated(mix(line_hash[real] ^ mix(line_row[real].astype(np.uint64) << np.uint64(40))))[1]

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int32)])
        return c[hi] - c[lo]

    upper, lower, size = count(_UPPER), count(_LOWER), np.maximum(hi - lo, 1)
    letters, w = np.maximum(upper + lower, 1), np.maximum(n_words, 1)
    symbols = count(_SYMBOL) / size
    last = np.zeros(len(lo), np.int64)
    last[line] = ends - 1  # of a line's words the last one stays
    dup, unique, runs = per_line(same) / w, 1 - per_line(again) / w, per_line(covered) / w
    x = np.stack(
        [np.log1p(hi - lo) / 8, np.log1p(n_words) / 6, np.minimum(size / w, 30) / 10, upper / letters, upper > 0.6 * letters, symbols * 5, symbols > 0.04, count(_DIGIT) / size * 5,
         np.minimum(count(_EXCLAIM) / w, 2), count(_BAR) / size * 5, dup, dup > 0.15, unique, unique < 0.5, runs, runs > 0.3, line_again,
         _END[data[last]] if len(data) else np.zeros(len(lo), bool), _UPPER[data[starts[np.minimum(first, words - 1)]]] if words else np.zeros(len(lo), bool), n_words < 4], axis=1,
    ).astype(np.float32)[real]
    row_of, weight = line_row[real], (hi - lo)[real]
    empty = np.setdiff1d(np.arange(rows), row_of)
    if len(empty):
        at = np.searchsorted(row_of, empty)
        row_of, weight, x = np.insert(row_of, at, empty), np.insert(weight, at, 1), np.insert(x, at, np.zeros((len(empty), x.shape[1]), np.float32), axis=0)
    return row_of, weight, x


def with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before, of the one after, and whether there are such."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    linked = row[1:] == row[:-1]
    before[1:][linked], after[:-1][linked] = x[:-1][linked], x[1:][linked]
    edge = np.ones((len(x), 2), np.float32)
    edge[1:, 0], edge[:-1, 1] = ~linked, ~linked
    return np.concatenate([np.ones((len(x), 1), np.float32), x, before, after, edge], axis=1)


def _layout(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line of each row, longest first, and their numbers of lines."""
    _, first, counts = np.unique(row, return_index=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    return first[order], counts[order]


def forward_backward(score: np.ndarray, trans: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good from what comes up to each line, and from what comes after it, for all rows side by side."""
    t = np.exp(trans - trans.max())
    a, b = score.copy(), np.zeros_like(score)
    active = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right") if len(counts) else []
    for s in range(1, len(active)):
        i = first[: active[s]] + s
        e = np.exp(np.clip(a[i - 1], -40, 40))
        a[i] += np.log((e * t[1, 1] + t[0, 1]) / (e * t[1, 0] + t[0, 0]))
    for s in range(len(active) - 2, -1, -1):
        i = first[: active[s + 1]] + s
        e = np.exp(np.clip(b[i + 1] + score[i + 1], -40, 40))
        b[i] = np.log((e * t[1, 1] + t[1, 0]) / (e * t[0, 1] + t[0, 0]))
    return a, b


def fit(row: np.ndarray, x: np.ndarray, good: np.ndarray) -> dict:
    """Parameters by Adam on the conditional likelihood; ``good`` is each line's label."""
    full = with_neighbours(row, x)
    mean, scale = full.mean(0, dtype=np.float64), full.std(0, dtype=np.float64)
    mean[0], scale[scale < 1e-6] = 0, 1
    full = ((full - mean) / scale).astype(np.float32)
    first, counts = _layout(row)
    docs, linked = len(first), np.flatnonzero(row[1:] == row[:-1])
    weights, trans = np.zeros(full.shape[1]), np.zeros((2, 2))
    m, v, n = [0.0, 0.0], [0.0, 0.0], len(row)
    y = good.astype(np.int64)
    seen = np.array([[np.sum((y[linked] == i) & (y[linked + 1] == j)) for j in (0, 1)] for i in (0, 1)], float)
    for step in range(1, ROUNDS + 1):
        score = full @ weights
        a, b = forward_backward(score, trans, first, counts)
        p = 1 / (1 + np.exp(-np.clip(a + b, -40, 40)))
        left, right = a[linked], (score + b)[linked + 1]
        cells = np.stack([trans[i, j] + i * left + j * right for i in (0, 1) for j in (0, 1)])
        cells = np.exp(cells - cells.max(0))
        expected = (cells / cells.sum(0)).sum(1).reshape(2, 2)
        grads = [full.T @ (good - p) / n - RIDGE * weights, (seen - expected) / n - RIDGE * trans]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            move = RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if k:
                trans = trans + move
            else:
                weights = weights + move
    return {"weights": weights, "trans": trans, "mean": mean, "scale": scale, "docs": docs}


def score_lines(model: dict, row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Marginal probability of good of each line."""
    score = ((with_neighbours(row, x) - model["mean"]) / model["scale"]) @ model["weights"]
    a, b = forward_backward(score, model["trans"], *_layout(row))
    return 1 / (1 + np.exp(-np.clip(a + b, -40, 40)))


def line_labels(row: np.ndarray, p: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines, of their marginals and their documents' labels: a bad document's worst lines are bad, whatever their marginal."""
    worst = np.full(len(good), np.inf)
    np.minimum.at(worst, row, p)
    return np.where(good[row] > 0, 1.0, ((p >= 0.5) & (p > worst[row])).astype(float))


def document_scores(row: np.ndarray, weight: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Mean marginal of each of ``n`` documents, weighted by the length of lines."""
    return np.bincount(row, weights=p * weight, minlength=n) / np.bincount(row, weights=weight, minlength=n)


def calibrate(s: np.ndarray, good: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve of ``good`` over ``s``, by Newton steps; the slope is not negative."""
    x, w = np.stack([s, np.ones(len(s))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (good - p) - ridge * w)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1))))


def fit_documents(row: np.ndarray, weight: np.ndarray, x: np.ndarray, good: np.ndarray) -> dict:
    """The field, fitted to labels of documents (``good``, one each), and the curve over its documents' averages."""
    alone = np.arange(len(row))
    y = line_labels(row, score_lines(fit(alone, x, good[row]), alone, x), good)
    for _ in range(TURNS):
        model = fit(row, x, y)
        p = score_lines(model, row, x)
        y = line_labels(row, p, good)
    return {**model, "curve": calibrate(document_scores(row, weight, p, len(good)), good)}


def _sampled(batches):
    for batch in batches:
        out, weights, ths = [], [], batch.column("th").to_numpy()
        for lo, hi, data, offsets in text_steps(batch.column("text"), 1 << 21):
            row, weight, x = line_features(data, offsets)
            counts = np.bincount(row, minlength=hi - lo)
            first = np.cumsum(counts) - counts + np.where(counts > LINES, ths[lo:hi] % np.maximum(1, counts - LINES + 1), 0)
            for f, n in zip(first, np.minimum(counts, LINES)):
                out.append(x[f : f + n].tobytes())
                weights.append(weight[f : f + n].astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("place", "doc_id", "th", "good")] + [pa.array(out, pa.binary()), pa.array(weights, pa.binary())], ["place", "doc_id", "th", "good", "lines", "weights"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fitted parameters, from at most ``sample`` labelled documents that may be learnt from."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    order = ["place", "doc_id", "th"]
    some = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("place", "doc_id", F.xxhash64("text").alias("th"), "good", "text")  # ``some`` has at most ``sample`` rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_sampled, f"place bigint, doc_id {kind}, th bigint, good boolean, lines binary, weights binary")
    got = found.orderBy(*order).limit(sample).select("good", "lines", "weights").collect()  # at most ``sample`` rows of LINES lines
    good = np.array([r["good"] for r in got], float)
    if len(set(good)) < 2:
        return {"prior": float(good[0]) if len(good) else 0.5}
    lines = [np.frombuffer(r["lines"], np.float32).reshape(-1, len(FEATURES)) for r in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in lines])
    return fit_documents(row, np.concatenate([np.frombuffer(r["weights"], np.int64) for r in got]), np.concatenate(lines), good)


def _scored(model: dict, keep: list[str]):
    def run(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in text_steps(batch.column("text"), 1 << 21):
                if "prior" in model:
                    out.append(np.full(hi - lo, model["prior"]))
                    continue
                row, weight, x = line_features(data, offsets)
                slope, intercept = model["curve"]
                out.append(1 / (1 + np.exp(-(slope * document_scores(row, weight, score_lines(model, row, x), hi - lo) + intercept))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.clip(np.concatenate([*out, np.zeros(0)]), 0, 1))], [*keep, "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
