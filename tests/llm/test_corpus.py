"""Corpus operators against brute force on small fixtures, and their defined edge cases."""

import hashlib
import itertools
import json
import random
import re
import unicodedata
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import common, components, crf_quality, decontaminate, license_scan, mixing, quality_rules, repeats, sharding, simhash, substring_index, suffix_array, warc
from tests.conftest import SF
from tests.helpers import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "Nu", "éa", "to") for b in ("ra", "se", "ti", "vo", "xù")]


def words(text):
    return WORD.findall(text or "")


def passage(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, blanks, nulls, a very long text, repeated rows."""
    rng = random.Random(5)
    shared = passage(rng, 80)
    out = [(i, passage(rng, rng.choice([1, 3, 8, 34, 36, 60, 200])) + "\n" + passage(rng, 5), "en", f"s{i % 4}") for i in range(40)]
    out += [(40, None, None, None), (41, "", "en", "s0"), (42, " \t\n ", "en", ""), (None, "no id here at all", "en", "s1"), (43, passage(rng, 9000), "en", "s2")]
    out += [(50 + i, passage(rng, 20) + " " + shared + " " + passage(rng, 15), "en", "s0") for i in range(6)]
    out += [(60 + i, out[4][1], "en", "s0") for i in range(5)] + [(70, "same again " * 60, "en", "s3")] * 3
    base = passage(rng, 300).split()
    for i in range(6):
        w = list(base)
        w[i * 7] = "changed"
        out.append((80 + i, " ".join(w), "en", "s1"))
    return [(d, t, l, s, len(t or "")) for d, t, l, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def sf(docs, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return json.dumps(row, ensure_ascii=False)


# --- helpers ----------------------------------------------------------------------------------------


def test_leftmost_minimum_and_words():
    v = np.random.default_rng(0).integers(0, 9, 60)
    for w in (1, 2, 3, 7, 26):
        assert [i + int(np.argmin(v[i : i + w])) for i in range(61 - w)] == common.leftmost_minimum(v, w).tolist()
    import pyarrow as pa

    texts = ["ab c  d\n", None, "", " x", "é yy ab"]
    got = []
    for i, _, data, offsets in common.text_steps(pa.array(texts), 4):
        starts, ends, row = common.word_bounds(data, offsets)
        got += [(i + r, bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]


def test_scratch_is_cleaned(spark):
    n = len(common.Scratch.live)
    a, b = common.Scratch(spark), common.Scratch(spark)
    a.save(spark.range(3), "x").count()
    at = Path(a.root.removeprefix("file://"))
    assert (at / "x").exists()
    a.drop("x", "never there")
    assert at.exists() and not (at / "x").exists()
    common.Scratch.close_since(n)
    assert not at.exists() and not Path(b.root.removeprefix("file://")).exists() and len(common.Scratch.live) == n


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark)).collect()}
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


# --- 1: sharding ------------------------------------------------------------------------------------


def test_sharding_limits(spark, docs, rows):
    many = docs.unionByName(spark.createDataFrame([(7, "z" * 400, "en", "s0", 400)] * 30, SCHEMA))
    out = sharding.shard_documents(many, 2000).collect()
    assert len(out) == len(rows) + 30
    groups = {}
    for r in out:
        groups.setdefault((r["shard_id"], r["overflow"]), []).append(r)
    for (bits, page), g in groups.items():
        size = sum(r["n_bytes"] for r in g)
        assert size <= 2000 or len(g) == 1
        assert {(r["shard_bytes"], r["shard_docs"]) for r in g} == {(size, len(g))} and all(len(bits) == r["depth"] for r in g)
    leaves = {b for b, _ in groups}
    assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)  # a prefix code
    assert max(p for _, p in groups) >= 6  # thirty equal rows of 400 bytes, five to a page
    whole = sharding.shard_documents(many, 2000, whole=True)
    assert set(docs.columns) < set(whole.columns) and whole.count() == len(out)


def test_sharding_splits_only_what_is_oversized(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"))
    out = sharding.shard_documents(df, 1000)
    assert out.agg(F.max("shard_bytes")).first()[0] <= 1000
    sizes = {r["shard_id"]: r["n"] for r in out.groupBy("shard_id").agg(F.sum("n_bytes").alias("n")).collect()}
    for bits in sizes:  # the parent of every leaf was over the limit
        parent = bits[:-1]
        assert sum(n for b, n in sizes.items() if b.startswith(parent)) > 1000
    d = sorted(sharding.directory(out).collect())
    assert d[0]["first"] == 0 and d[-1]["last"] == (1 << d[0]["global_depth"]) - 1 and all(a["last"] + 1 == b["first"] for a, b in zip(d, d[1:]))
    assert all(format(e, f"0{r['global_depth']}b").startswith(r["shard_id"]) for r in d for e in (r["first"], r["last"]))
    deep = spark.createDataFrame([(7, "z" * 400, "en", "s0", 400)] * 30 + [(8, "y", "en", "s0", 1)], SCHEMA)
    pages = {r["shard_id"]: r for r in sharding.directory(sharding.shard_documents(deep, 2000)).collect()}
    assert len(pages) == 2 and max(r["global_depth"] for r in pages.values()) == 60


def test_sharding_of_uneven_cells(spark):
    """One shallow leaf with many cells, beside one that splits far down: against splitting bucket by bucket."""
    rng = random.Random(3)
    rows = [(rng.getrandbits(59) | 1 << 59, 1) for _ in range(400)] + [((0b0001 << 56) + rng.getrandbits(40), 100) for _ in range(300)] + [(5, 5000)]
    df = spark.createDataFrame(rows, "h long, b long")
    got = Counter((r["h"], r["b"], r["shard_id"], r["shard_bytes"]) for r in sharding.shard(df, F.col("h"), F.col("b"), 1000).collect())
    want = Counter()

    def split(part, bits):
        size = sum(b for _, b in part)
        if size <= 1000 or len(bits) == 60:
            want.update((h, b, bits, size) for h, b in part)
            return
        for x in "01":
            split([r for r in part if format(r[0], "060b")[len(bits)] == x], bits + x)

    split(rows, "")
    assert got == want


def test_sharding_edges(spark, empty, docs):
    assert sharding.shard_documents(empty).count() == 0
    one = sharding.shard_documents(docs, 1 << 40).collect()
    assert {(r["shard_id"], r["depth"]) for r in one} == {("", 0)}
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)
    odd = docs.withColumn("Depth", F.lit("own")).withColumn("cell", F.lit(2)).withColumn("_h", F.lit(3)).withColumn("a.b", F.lit(4)).withColumn("copies", F.lit(5))
    out = sharding.shard_documents(odd.unionByName(odd.filter("doc_id = 70")), 300, whole=True)  # names in the way, and overflow pages
    assert out.columns == [*odd.columns, "shard_id", "depth_", "overflow", "shard_bytes", "shard_docs"]
    assert {(r["Depth"], r["cell"], r["a.b"]) for r in out.collect()} == {("own", 2, 4)} and out.agg(F.max("overflow")).first()[0] > 0
    long = spark.createDataFrame([(1, "x" * 3_000_000, "en", "s", 1), (2, "y", "en", "s", 1)], SCHEMA)
    assert {r["doc_id"]: r["shard_docs"] for r in sharding.shard_documents(long).collect()} == {1: 1, 2: 1}


# --- 2: quality classifier --------------------------------------------------------------------------


def test_crf_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in crf_quality.op2_crf_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    tested = [(r["quality"], out[r["doc_id"]]["predicted"]) for r in labels if out[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in tested]) > 0.97


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    score, trans, row = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    a, b = crf_quality.forward_backward(score, trans, *crf_quality._layout(row))
    got = 1 / (1 + np.exp(-(a + b)))
    for r in range(3):
        x = score[row == r]
        total, good = 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            p = np.exp(sum(s * k for s, k in zip(x, y)) + sum(trans[i, j] for i, j in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(got[row == r], good / total)


def test_crf_edges(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in crf_quality.score(docs, crf_quality.train(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = crf_quality.train(docs, labels)
    out = crf_quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert crf_quality.score(empty, model).count() == 0


def plain_features(text):
    """(bytes, features) of each line with a word, one line at a time; of a text without words one empty line."""
    upper, lower = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"abcdefghijklmnopqrstuvwxyz") | set(range(0xC3, 256))
    raw = (text or "").encode()
    every, out, before = raw.split(), [], set()
    runs = Counter(tuple(every[i : i + 5]) for i in range(len(every) - 4))
    covered = {j for i in range(len(every) - 4) if runs[tuple(every[i : i + 5])] > 1 for j in range(i, i + 5)}
    at = 0
    for line in [x + b"\n" for x in raw.split(b"\n")[:-1]] + raw.split(b"\n")[-1:]:
        w = line.split()
        if not w:
            continue
        n, size = len(w), len(line)
        has = lambda chars: sum(c in chars for c in line)
        ups, letters = has(upper), max(1, has(upper) + has(lower))
        symbols = has(b"#*$%&|<>=~^_{}\\@+") / size
        same = sum(x == y for x, y in zip(w, w[1:])) / n
        rep = sum(j in covered for j in range(at, at + n)) / n
        out.append((size, [
            np.log1p(size) / 8, np.log1p(n) / 6, min(size / n, 30) / 10, ups / letters, ups > 0.6 * letters, symbols * 5, symbols > 0.04, has(b"0123456789") / size * 5, min(has(b"!") / n, 2), has(b"|-_/") / size * 5,
            same, same > 0.15, len(set(w)) / n, len(set(w)) / n < 0.5, rep, rep > 0.3, tuple(w) in before, w[-1][-1] in b".!?:;\"')", w[0][0] in upper, n < 4]))
        before.add(tuple(w))
        at += n
    return out or [(1, [0.0] * len(crf_quality.FEATURES))]


def test_line_features_against_one_line_at_a_time(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows] + ["A | B | c\nTWO TWO TWO!!\nTWO TWO TWO!!\n\n x_y 12%\n", "\n\n", "é È ß.", "one\n" * 3]
    for most in (1 << 20, 1):  # all rows in a step, and each in its own
        got = []
        for lo, hi, data, offsets in common.text_steps(pa.array(texts), most):
            row, weight, x = crf_quality.line_features(data, offsets)
            got += [[(w, f) for r, w, f in zip(row, weight, x) if r == i] for i in range(hi - lo)]
        for text, lines in zip(texts, got):
            want = plain_features(text)
            assert [w for w, _ in lines] == [w for w, _ in want] and np.allclose([f for _, f in lines], np.array([f for _, f in want], float), atol=1e-5), text


def test_lines_are_told_apart():
    """Bad documents that are half clean: the field finds which half, though it learns from documents' labels alone."""
    import pyarrow as pa

    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(6, 12))).capitalize() + "."
    junk = lambda: " | ".join(rng.choice(VOCABULARY).upper() for _ in range(rng.randint(6, 12))) + " %%%"
    texts, good, truth = [], [], []
    for i in range(200):
        kinds = [1.0] * rng.randint(4, 10)
        if i % 3 == 0:
            kinds += [0.0] * len(kinds)
            if i % 2:
                kinds.reverse()
        texts.append("\n".join(clean() if k else junk() for k in kinds))
        good.append(float(i % 3 > 0))
        truth += kinds
    _, _, data, offsets = next(common.text_steps(pa.array(texts), 1 << 24))
    row, weight, x = crf_quality.line_features(data, offsets)
    model = crf_quality.fit_documents(row, weight, x, np.array(good))
    p = crf_quality.score_lines(model, row, x)
    assert np.mean((p >= 0.5) == np.array(truth)) > 0.97
    scores = crf_quality.document_scores(row, weight, p, len(good))
    assert np.allclose(scores, [np.dot(p[row == i], weight[row == i]) / weight[row == i].sum() for i in range(len(good))])
    slope, intercept = model["curve"]
    assert np.mean((slope * scores + intercept > 0) == np.array(good)) > 0.97 and slope > 0
    stay, change = model["trans"][0, 0] + model["trans"][1, 1], model["trans"][0, 1] + model["trans"][1, 0]
    assert stay > change and np.isfinite(model["trans"]).all()


def test_crf_query_edges(spark, tmp_path, rows):
    """Through the query: blanks, repeated rows, extra and clashing columns, no table rows; reruns agree."""
    odd = spark.createDataFrame([(*r[:4], 1, "x", 2.0) for r in rows] + [(7, "z " * 200_000, "en", "s", 1, "x", 2.0)], "doc_id long, text string, lang string, source string, good int, th string, score double")
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    run = lambda: sorted(crf_quality.op2_crf_quality(spark, f"{tmp_path}/a").collect(), key=str)
    out = run()
    assert len(out) == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in out) and out == run()
    assert Counter(r["doc_id"] for r in out) == Counter([r[0] for r in rows] + [7])
    assert len({r["score"] for r in out if r["doc_id"] in (40, 41, 42)}) == 1  # null, empty and blank alike
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/labels.parquet").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert crf_quality.op2_crf_quality(spark, f"{tmp_path}/b").count() == 0


# --- 3 and 5: repeats -------------------------------------------------------------------------------


def repeated_words(rows, length):
    """Of each row, which words lie in a window that starts anywhere else too."""
    seen = Counter(tuple(w[i : i + length]) for w in map(words, (r[1] for r in rows)) for i in range(len(w) - length + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((w, gone))
    return out


def test_substring_index(spark, sf, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_index.op5_substring_index(spark, sf).collect())
    want = Counter((r[0], len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for r, (w, g) in zip(rows, repeated_words(rows, 35)))
    assert got == want and sum(n for (_, _, n, _) in got) > 0


def test_index_is_incremental(spark, docs, rows, tmp_path):
    """Batch by batch, each merge-joined with the runs before it, over a reopened index; texts are cut against all seen so far."""
    cuts = [(None, 43), (43, 63), (63, 70), (70, 99)]
    parts = [[r for r in rows if (r[0] if r[0] is not None else -1) >= (lo or -1) and (r[0] if r[0] is not None else -1) < hi] for lo, hi in cuts]
    assert sum(map(len, parts)) == len(rows)
    scratch, root = common.Scratch(spark), f"file://{tmp_path}/index"
    index, past, levels = substring_index.FingerprintIndex(spark, root, 8), [], []
    for i, part in enumerate(parts):
        batch = spark.createDataFrame(part, SCHEMA)
        sums = repeats.summed(repeats.blocks(batch, 35, 10))
        if index.runs:
            plan = index.seen(scratch.save(sums, f"sums{i}"))._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1  # the runs are not shuffled
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_index.remove_repeats(batch, 1, index, spark.createDataFrame(past, SCHEMA) if past else None).collect())
        want = repeated_words(past + part, 35)[len(past) :]
        assert got == Counter((r[0], len(w), sum(g)) for r, (w, g) in zip(part, want))
        past += part
        levels.append([level for _, level in index.runs])
        for name, _ in index.runs:
            spark.sql(f"DROP TABLE {name}")  # another session knows no table
        index = substring_index.FingerprintIndex.open(spark, root)
        assert index.buckets == 8
    assert levels == [[0], [0, 0], [1, 0], [1, 0, 0]]
    index.compact()
    assert [level for _, level in index.runs] == [2]
    kept = {tuple(r) for r in spark.table(index.runs[0][0]).collect()}
    assert kept == {tuple(r) for r in repeats.summed(repeats.blocks(docs, 35, 10)).select("anchor", "n", "least", "most").collect()}
    with pytest.raises(ValueError):
        substring_index.remove_repeats(docs, 1, index)
    index.drop()
    with pytest.raises(ValueError):
        substring_index.FingerprintIndex.open(spark, root)


def test_substring_index_query_edges(spark, tmp_path, rows):
    odd = spark.createDataFrame([(*r[:4], 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, th int, anchor int, spans string")
    for name, df in (("a", odd), ("b", odd.limit(0)), ("c", odd.filter("doc_id IN (40, 41, 42)"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_index.op5_substring_index(spark, f"{tmp_path}/{name}").collect())
        some = [r for r in rows if name == "a" or (name == "c" and r[0] in (40, 41, 42))]
        assert got == Counter((r[0], len(w), sum(g)) for r, (w, g) in zip(some, repeated_words(some, 35)))


def repeated_runs(rows, length):
    out = Counter()
    for r, (w, g) in zip(rows, repeated_words(rows, length)):
        at = 0
        for on, run in itertools.groupby(g):
            n = len(list(run))
            if on:
                out[(r[0], at, at + n)] += 1
            at += n
    return out


def test_suffix_array(spark, docs, rows):
    got = Counter(tuple(r) for r in suffix_array.repeated_passages(docs).collect())
    assert got == repeated_runs(rows, 50) and len(got) > 5 and max(got.values()) >= 3  # of three equal rows each has its own


def crossing_rows(rng, n):
    """Texts around common cores whose longest left and right extensions belong to different texts."""
    cores = [passage(rng, 14) for _ in range(3)]
    lefts, rights = [passage(rng, 45).split() for _ in range(3)], [passage(rng, 45).split() for _ in range(3)]
    out = []
    for i in range(n):
        left, right = rng.choice(lefts)[-rng.randint(0, 45) or 45 :], rng.choice(rights)[: rng.randint(0, 45)]
        text = passage(rng, rng.randint(0, 9)).split() + left + rng.choice(cores).split() + right + passage(rng, rng.randint(0, 9)).split()
        out.append((i if i % 7 else None, " ".join(text), "en", "s", 0))
    return out


def test_suffix_array_where_left_and_right_belong_to_different_texts(spark):
    rows = crossing_rows(random.Random(12), 300)
    want = repeated_runs(rows, 50)
    for parts in ("1", "4", "60"):  # with 60 ranges most rows lie at the edge of one
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = Counter(tuple(r) for r in suffix_array.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want and sum(want.values()) > 20


def test_suffixes_are_in_order_and_extended(spark, docs, rows):
    """The order is that of the words after the anchor; extensions are those of every pair of neighbours, word by word."""
    scratch = common.Scratch(spark)
    found = repeats.blocks(docs, 50, 12)
    hits = found.join(repeats.repeated_anchors(repeats.summed(found)).drop("n"), "anchor").withColumn("whole", F.lit(False))
    ordered = suffix_array._in_order(scratch.save(suffix_array.suffixes(docs, hits), "s"), True, 3)
    parts = ordered.withColumn("part", F.spark_partition_id()).collect()
    for part in {r["part"] for r in parts}:
        own = [r for r in parts if r["part"] == part]
        keys = [(r["anchor"], bytes(r["right"]), bytes(r["left"])) for r in own]
        assert keys == sorted(keys) and len(own) > 2
        for a, r, b in zip(own, own[1:], own[2:]):
            mask = 0
            for x in (a, b):
                if x["anchor"] == r["anchor"]:
                    cut = lambda v: [bytes(v[i : i + 5]) for i in range(0, len(v), 5)]
                    same = lambda c: next((i for i, (p, q) in enumerate(zip(cut(r[c]), cut(x[c]))) if p != q), min(len(r[c]), len(x[c])) // 5)
                    mask |= sum(1 << k for k in range(r["n"]) if r["off"] - k <= same("left") and 38 - (r["off"] - k) <= same("right"))
            assert r["mask"] == mask


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(500).select((F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40)).alias("k"), "id", F.lit("x").alias("n"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("twice", F.col("n") > 4)
    got = common.join_counted(rows, counts, ["k"], common.Scratch(spark), "hot")
    assert sorted(map(tuple, got.select("k", "id", "n", "twice").collect())) == sorted(map(tuple, rows.join(counts.drop("n"), "k").select("k", "id", "n", "twice").collect()))
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_repeats_edges(spark, empty, docs):
    assert substring_index.remove_repeats(empty).count() == 0 and suffix_array.repeated_passages(empty).count() == 0
    blank = substring_index.remove_repeats(docs.filter("doc_id IN (40, 41, 42)")).collect()
    assert {(r["n_words"], r["n_removed"], r["kept_text"]) for r in blank} == {(0, 0, "")}


# --- 4: WARC ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- no <p>this</p> --><p>One <b>bold</b> &lt;x&gt; caf&eacute; &#8364;</p><a href='/u?a=1&amp;b=2' title="a>b">link</a><br>two<script>if (a < b) {}</script> 3 < 4</body></html>"""


class Plain(HTMLParser):
    """Reference extraction with the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]
        self.out.append("\n" if tag in warc.BLOCK else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append("\n" if tag in warc.BLOCK else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def by_parser(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(y.replace("\xa0", " ").split()) for y in "".join(p.out).split("\n")) if x), p.links


def test_extraction(spark):
    text, title, lang, links = warc.extract(PAGE)
    assert (title, lang, links) == ("A & B", "fr", ["/u?a=1&b=2"]) and "no" not in text and "var t" not in text
    assert "One bold <x> café €" in text and "3 < 4" in text
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert warc.extract(r["html"])[0::3] == by_parser(r["html"])
    for broken in ("<!-- open", "<script>x", "a < b", "<p", "<a href=", "<title>x", "<" * 5000, "<a " * 5000):
        warc.extract(broken)
    assert warc.extract("a <b c 'd> e")[0] == "a <b c 'd> e" and warc.extract("<p title='>'>x</p>")[0] == "x"


def test_broken_pages_take_linear_time():
    import time

    n = 1 << 20
    for unit in ("<a ", "<a\"", "<a '\"", "<a b=\"c'", "<", "<a<b", "</", "<!-", "<p title=\"", "<a href='x\" ", "<title>", "<script "):
        page = unit * (n // len(unit))
        for text in (page, page + ">", "<p>" + page + "\"'>"):
            began = time.time()
            warc.extract(text)
            assert time.time() - began < 5, unit


def test_derived_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", PAGE, 0), (2, None, None, 0), (3, "http://b", "", 0), (1, "http://a/x", PAGE, 0)], "page_id long, url string, html string, record int")
    out = warc.derive(warc.responses(pages)).collect()
    assert len(out) == 8
    for r in out:
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    pair = [r for r in out if r["page_id"] == 1]
    assert len({r["refers_to"] for r in pair}) == 1 and len({r["record_id"] for r in pair}) == 2 and {r["source_payload_digest"] for r in pair} == {warc.digest(PAGE.encode())}
    assert "source-header: Content-Type: text/html" in next(r["block"] for r in pair if r["warc_type"] == "metadata")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    warc.write_warc(warc.derive(warc.responses(pages)), str(tmp_path / "w"), "gzip")
    back = [x for f in (tmp_path / "w").glob("part*") for x in warc.parse(f.read_bytes())]
    assert sorted((h["warc-record-id"], b.decode()) for h, b in back) == sorted((r["record_id"], r["block"]) for r in out)


def test_reading_responses(spark, tmp_path):
    body = PAGE.encode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "a.warc").write_bytes(head + http + b"\r\n\r\n" + head.replace(b"response", b"request") + http + b"\r\n\r\n")
    got = warc.read_responses(spark, str(tmp_path / "a.warc"))
    out = warc.derive(got.withColumn("page_id", F.lit(1).cast("long"))).collect()
    assert len(out) == 2 and {r["refers_to"] for r in out} == {"<urn:uuid:1>"} and {r["target_uri"] for r in out} == {"http://a"} and "Server: x" in out[0]["source_header"]


def test_reading_many_records(spark, tmp_path):
    """Plain, gzipped by record, gzipped without saying so, and with the mark between records inside a page: all as by lengths alone."""
    import gzip

    rng = random.Random(9)

    def record(i, body):
        http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body
        kind = ("response", "request", "response")[i % 3]
        return f"WARC/1.{i % 2}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://a/{i}\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    bodies = [rng.randbytes(rng.randint(0, 3000)) + b"\r\n\r\n" * (i % 2) for i in range(60)]
    odd = [*bodies[:20], b"x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"]
    (tmp_path / "plain.warc").write_bytes(b"".join(record(i, b) for i, b in enumerate(bodies)))
    (tmp_path / "zipped.warc.gz").write_bytes(b"".join(gzip.compress(record(100 + i, b)) for i, b in enumerate(bodies)))
    (tmp_path / "unnamed.warc").write_bytes(gzip.compress(b"".join(record(200 + i, b) for i, b in enumerate(bodies))))
    (tmp_path / "odd.warc").write_bytes(b"".join(record(300 + i, b) for i, b in enumerate(odd)))
    got = Counter((r["record_id"], r["target_uri"], bytes(r["payload"])) for r in warc.read_responses(spark, str(tmp_path)).collect())
    want = Counter((f"<urn:uuid:{at + i}>", f"http://a/{at + i}", b) for at, many in ((0, bodies), (100, bodies), (200, bodies), (300, odd)) for i, b in enumerate(many) if (at + i) % 3 != 1)
    assert got == want
    for name in ("unnamed.warc", "odd.warc"):
        (tmp_path / name).unlink()
    assert warc.read_responses(spark, str(tmp_path)).count() == sum(n for (i, _, _), n in want.items() if int(i[10:-1]) < 200)


# --- 6: licences ------------------------------------------------------------------------------------


def license_shingles(text):
    w = [x for x in re.split(r"[^\w.]+|_", re.sub(r"\.(?=[^\w]|_|$)", " ", (text or "").lower())) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_license_scan(spark, rows):
    gpl, mit = license_scan.TEMPLATES["GPL-3.0 notice"], license_scan.TEMPLATES["MIT"]
    some = rows[:20] + [(900, f"foo bar {gpl} and more", "en", "s", 0), (901, "x " * 5000 + mit + " y" * 3000, "en", "s", 0), (902, mit.replace("granted", "given"), "en", "s", 0), (903, " ".join(mit.split()[:30]), "en", "s", 0), (None, "Released under the MIT License.", "en", "s", 0)]
    out = license_scan.scan(spark.createDataFrame(some, SCHEMA), license_scan.built_in(spark)).collect()
    got = {(r["doc_id"], r["template"]) for r in out}
    want = set()
    for name, text in license_scan.TEMPLATES.items():
        t = set(license_shingles(text))
        size = 1 << (len(t) - 1).bit_length()
        for r in some:
            s = license_shingles(r[1])
            if any(len(t & set(s[i : i + 2 * size])) >= 0.8 * len(t) for i in range(0, max(1, len(s)), size)):
                want.add((r[0], name))
    assert got == want and {(900, "GPL-3.0 notice"), (901, "MIT"), (902, "MIT"), (None, "MIT notice")} <= got and (903, "MIT") not in got


def test_license_bands_and_bounds(spark, empty, docs, monkeypatch):
    assert license_scan.scan(empty, license_scan.built_in(spark)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, spark.createDataFrame([("x", "too short")], "template string, text string"))
    some = spark.createDataFrame([(1, "a b c " + license_scan.TEMPLATES["BSD"], "en", "s", 0)], SCHEMA)
    near = sorted(map(str, license_scan.scan(some, license_scan.built_in(spark)).collect()))
    monkeypatch.setattr(license_scan, "SET_BOUND", 0)  # the way for many templates
    assert sorted(map(str, license_scan.scan(some, license_scan.built_in(spark)).collect())) == near != []


def test_license_hits_in_a_very_long_text(spark, monkeypatch):
    """10^5 words with a notice at every tenth: windows leave the row, not the row's shingles with every hit."""
    import time

    gpl = license_scan.TEMPLATES["GPL-3.0 notice"]
    text = " ".join(f"w{i} " + (gpl if i % 2 else "some filler words that are no notice at all") for i in range(8_000))
    some = spark.createDataFrame([(1, text, "en", "s", 0, 7), (2, gpl, "en", "s", 0, 7)], SCHEMA + ", row int")  # and a name in the way
    for bound in (license_scan.SET_BOUND, 0):
        monkeypatch.setattr(license_scan, "SET_BOUND", bound)
        began = time.time()
        got = Counter((r["doc_id"], r["template"]) for r in license_scan.scan(some, license_scan.built_in(spark)).collect())
        assert got[(2, "GPL-3.0 notice")] == 1 and got[(1, "GPL-3.0 notice")] >= 3_900 and time.time() - began < 60


def test_license_later_passages(spark):
    """A text that holds only the warranty clause, or only a middle section, of a licence."""
    folder = Path(license_scan.__file__).parent / "licenses"
    mit, apache = (" ".join((folder / f"{n}.txt").read_text().split()) for n in ("MIT", "Apache-2.0"))
    some = [(1, "x " * 40 + mit[mit.index("THE SOFTWARE IS") :] + " y", "en", "s", 0), (2, apache[4000:6500], "en", "s", 0), (3, "nothing of the kind " * 50, "en", "s", 0)]
    got = {(r["doc_id"], r["template"].split(" part ")[0]) for r in license_scan.scan(spark.createDataFrame(some, SCHEMA), license_scan.built_in(spark)).collect()}
    assert {(1, "MIT"), (2, "Apache-2.0")} <= got and not [x for x in got if x[0] == 3]
    for file in folder.glob("*.txt"):
        parts = license_scan.passages(file.stem, file.read_text())
        assert set(license_shingles(file.read_text())) <= {s for p in parts.values() for s in license_shingles(p)}


def test_license_phrases(spark, empty, docs, monkeypatch):
    some = spark.createDataFrame([(1, "All rights reserved.", "en", "s", 0), (2, "a, ALL\nRIGHTS reserved! all rights reserved", "en", "s", 0), (3, "all rights", "en", "s", 0), (4, "all my rights reserved", "en", "s", 0), (5, None, "en", "s", 0), (None, "x all rights reserved", "en", "s", 0)], SCHEMA)
    phrases = spark.createDataFrame([("reserved", "All rights reserved."), ("rights", "all rights")], "template string, text string")
    want = Counter({(1, "reserved", 0): 1, (2, "reserved", 1): 1, (2, "reserved", 4): 1, (None, "reserved", 1): 1, (1, "rights", 0): 1, (2, "rights", 1): 1, (2, "rights", 4): 1, (3, "rights", 0): 1, (None, "rights", 1): 1})
    found = lambda: Counter((r["doc_id"], r["template"], r["first_shingle"]) for r in license_scan.scan_phrases(some, phrases).collect())
    assert found() == want
    monkeypatch.setattr(license_scan, "SET_BOUND", 0)
    assert found() == want and license_scan.scan_phrases(empty, phrases).count() == 0 and license_scan.scan_phrases(docs, phrases.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_phrases(docs, spark.createDataFrame([("x", "this has five words here")], "template string, text string"))


# --- 7: quality rules -------------------------------------------------------------------------------


def base_measures(text):
    w, t = words(text), text or ""
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def estimate(patterns):
    """The same expectation-maximisation in plain Python: (posterior of each pattern, rates of bad votes by kind)."""
    share, bad = quality_rules.starting_shares(), quality_rules.starting_rates()
    kinds, rules = range(len(share)), range(len(bad[0]))

    def posterior(v):
        p = [share[c] * np.prod([bad[c][j] if v[j] < 0 else 1 - bad[c][j] if v[j] else 1.0 for j in rules]) for c in kinds]
        return [x / sum(p) for x in p]

    for _ in range(quality_rules.ROUNDS):
        g = {v: posterior(v) for v in patterns}
        total = lambda c, j, of: sum(n * g[v][c] for v, n in patterns.items() if v[j] in of)
        share_ = [(sum(n * g[v][c] for v, n in patterns.items()) + 1) / (sum(patterns.values()) + len(share)) for c in kinds]
        share, bad = share_, [[(total(c, j, (-1,)) + 1) / (total(c, j, (-1, 1)) + 2) for j in rules] for c in kinds]
    return {v: posterior(v)[0] for v in patterns}, bad


def test_quality_rules(spark, sf, rows):
    out = quality_rules.op7_quality_rules(spark, sf).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert got == Counter((r[0], *base_measures(r[1])) for r in rows)
    patterns = Counter(tuple(map(int, r["votes"].split(","))) for r in out)
    want, _ = estimate(patterns)
    for r in out:
        p = want[tuple(map(int, r["votes"].split(",")))]
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert abs(r["posterior"] - p) < 2e-6 and r["base_failed"] == failed and r["kept"] == (not failed and p >= 0.5)


def test_quality_rules_on_labels(spark):
    """Estimation decides, not a bad vote alone: of documents with a bad vote many stay, and each rate is what the documents show."""
    sf = "/root/testdata/sf0.01"
    rows = quality_rules.op7_quality_rules(spark, sf).collect()
    judged = {r["doc_id"]: r for r in rows if not r["base_failed"]}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in judged]
    assert np.mean([judged[r["doc_id"]]["kept"] for r in labels if r["quality"]]) > 0.98 and np.mean([judged[r["doc_id"]]["kept"] for r in labels if not r["quality"]]) < 0.1
    some_bad = [r for r in judged.values() if "-1" in r["votes"]]
    assert len([r for r in some_bad if r["kept"]]) >= 5 and len([r for r in some_bad if not r["kept"]]) >= 20
    patterns = Counter(tuple(map(int, r["votes"].split(","))) for r in rows)
    want, bad = estimate(patterns)
    assert all(abs(want[tuple(map(int, r["votes"].split(",")))] - r["posterior"]) < 2e-6 for r in rows)
    at = {n: j for j, n in enumerate(quality_rules.RULES)}
    for c, family in enumerate(quality_rules.FAMILIES.values(), 1):
        assert sorted(bad[c][at[n]] for n in family)[-2] > 0.5 and all(bad[0][at[n]] < 0.1 for n in family)  # two rules or more see each kind
    assert quality_rules.BAD_OF_GOOD not in bad[0] and len({round(x, 9) for x in bad[0]}) > quality_rules.K // 2  # no common bound


def test_estimation_weighs_rules(spark):
    """A rule that votes bad at random is told from two that agree."""
    rng = random.Random(4)
    at = {n: j for j, n in enumerate(quality_rules.RULES)}
    voted = []
    for i in range(3000):
        v = [1] * quality_rules.K
        if i % 10 == 0:
            v[at["symbols"]] = -1 if rng.random() < 0.9 else 1
            v[at["marks"]] = -1 if rng.random() < 0.8 else 1
        v[at["length"]] = -1 if rng.random() < 0.3 else 1
        voted.append((v,))
    got = {tuple(r["votes"]): r["posterior"] for r in quality_rules.posteriors(spark.createDataFrame(voted, "votes array<int>")).collect()}
    pattern = lambda *bad: tuple(-1 if n in bad else 1 for n in quality_rules.RULES)
    assert got[pattern("length")] > 0.9 and got[pattern("symbols", "marks")] < 0.01 and got[pattern("symbols", "marks", "length")] < 0.01
    assert all(abs(got[v] - p) < 1e-9 for v, p in estimate(Counter(tuple(v) for (v,) in voted))[0].items())


def test_filter_quality(spark, docs, empty):
    odd = docs.withColumn("votes", F.lit(1)).withColumn("posterior", F.lit("x"))
    out = quality_rules.filter_quality(odd)
    assert out.columns == odd.columns and 0 < out.count() < docs.count() and quality_rules.filter_quality(empty).count() == 0


# --- 8: SimHash -------------------------------------------------------------------------------------


def print_of(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Least id reachable of each position in a list of (id, fingerprint)."""
    n, parent = len(prints), list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array([p for _, p in prints], np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4):
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(n)]


def test_simhash(spark, sf, rows):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash(spark, sf).collect())
    prints = [(r[0], print_of(r[1])) for r in rows]
    assert got == Counter((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints)))


def test_covering_and_hot_buckets(spark, monkeypatch):
    rng = random.Random(2)
    for bits in ((1 << 64) - 1, (1 << 31) - 1, 0b1011011):
        masks, own = simhash.covering_masks(bits), [b for b in range(64) if bits >> b & 1]
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(own, 4))
            assert any(m & d == 0 for m in masks)
    firsts = simhash.covering_masks()
    assert max(64 - (firsts[t] | m).bit_count() for t, _, m in simhash.deep_masks()) <= simhash.DEEP_BITS  # what a second deal leaves
    base = rng.getrandbits(64)
    prints = [(i, base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9)))) for i in range(400)]
    prints += [(400 + i, base ^ sum(1 << b for b in range(14) if i >> b & 1) & ~firsts[3]) for i in range(1 << 14)][:600]
    df = spark.createDataFrame([(i, simhash._signed(p)) for i, p in prints], "doc_id long, fp long")
    plain = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda d, s, r: plain(d, s, r, 8))  # buckets over 8 are dealt out again
    got = {r["doc_id"]: r["component_id"] for r in simhash.cluster(df, common.Scratch(spark)).collect()}
    assert [got[i] for i, _ in prints] == brute_components(prints)


def test_one_bucket_of_many_fingerprints(spark):
    """10^5 fingerprints that agree on one table's mask: rows stay within two deals, and links are those of all pairs."""
    rng = np.random.default_rng(8)
    mask = simhash.covering_masks()[5]
    free = [b for b in range(64) if not mask >> b & 1]
    some = rng.integers(0, 1 << len(free), 100_000)
    prints = np.unique(sum(((some >> k) & 1).astype(np.uint64) << np.uint64(b) for k, b in enumerate(free)) | np.uint64(mask & 0x0123456789ABCDEF))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    scratch = common.Scratch(spark)
    links = simhash.near_links(df, scratch)
    got = {r["node"]: r["root"] for r in components.components(links, scratch).collect()}
    hot = spark.read.parquet(f"{scratch.root}/buckets").filter(F.col("n") > simhash.CAP)
    wide = spark.read.parquet(f"{scratch.root}/hot")
    assert 1 <= wide.count() <= hot.count() and (5, simhash._signed(mask & 0x0123456789ABCDEF)) in {tuple(r) for r in wide.select("t", "masked").collect()}
    dealt = spark.read.parquet(f"{scratch.root}/buckets").join(wide, ["t", "masked"]).agg(F.sum("n")).first()[0] * len(simhash.covering_masks())
    assert dealt <= 31 * 2 * len(prints)
    # brute force on a slice of the fingerprints against all
    for x in prints[::500]:
        near = prints[(np.bitwise_count(prints ^ x) <= 4) & (prints != x)]
        for y in near:
            a, b = int(x.view(np.int64)), int(y.view(np.int64))
            assert got[a] == got[b]
    assert set(got) <= set(prints.view(np.int64).tolist())


def test_drop_near_duplicates(spark, docs, rows, empty):
    out = simhash.drop_near_duplicates(docs)
    prints = [(i, print_of(r[1])) for i, r in enumerate(rows)]
    assert out.columns == docs.columns and out.count() == len(set(brute_components(prints))) and simhash.drop_near_duplicates(empty).count() == 0
    kept = [tuple(r) for r in out.collect()]
    assert Counter(map(key, kept)) <= Counter(map(key, rows)) and sum(r[0] in range(60, 65) or r[0] == 4 for r in kept) == 1


# --- 9: decontamination -----------------------------------------------------------------------------


def tokens(text):
    out, opens, number = [], True, False
    for line in (text or "").split("\n"):
        opens = True
        for w in words(line):
            core = re.sub(r"^[\W_]+|[\W_]+$", "", w)
            ends = w.endswith(decontaminate._ENDS)
            if not core:
                opens = opens or ends
                continue
            number_now = core[0].isdigit() or core.lower() in decontaminate._NUMBERS
            if number_now:
                out.append(("NUM", core.lower()))
            elif core.lower() in decontaminate._UNITS and number:
                out.append(("UNIT", core.lower()))
            elif core[0].isupper() and not core[1:].isupper() and not opens:
                out.append(("NAME", core.lower()))
            else:
                out.append((core.lower(), None))
            number, opens = number_now, ends
    return out


def brute_contamination(docs, items):
    out = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = tokens(text), tokens(item)
        n = len(b) - 4
        if n <= 0:
            plain = lambda x: [v or t for t, v in x]
            if b and any(plain(a)[x : x + len(b)] == plain(b) for x in range(len(a))):
                out.add((d, i, 1, 1))
            continue
        hit = {}
        for x in range(len(a) - 4):
            for y in range(n):
                if [t for t, _ in a[x : x + 5]] == [t for t, _ in b[y : y + 5]]:
                    hit.setdefault(x - y, []).append((y, [(p[1] and p[0] + p[1], q[1] and q[0] + q[1]) for p, q in zip(b[y : y + 5], a[x : x + 5]) if p[1]]))
        found = set()
        for group in hit.values():
            pairs = {p for _, ps in group for p in ps}
            names = sum(p != q and p.startswith("NAME") for p, q in pairs)
            covered = {y + k for y, _ in group for k in range(5)}
            if len({p for p, _ in pairs}) == len(pairs) and names <= 0.2 * len(covered) + 1e-9:
                found |= {y for y, _ in group}
        if len(found) >= 0.8 * n:
            out.add((d, i, n, len(found)))
    return out


def test_decontamination(spark, empty):
    item = "A train leaves Boston at 60 km per hour and meets Alice after 3 hours near Boston again today."
    other = item.replace("Boston", "Paris").replace("60", "85").replace("Alice", "Bob")
    broken = item.replace("near Boston", "near Lyon")
    texts = [(1, "Before it. " + item + " And after."), (2, "before,\n" + other), (3, broken), (4, "nothing like it"), (5, None), (6, ""), (None, item), (7, item + " " + item), (7, item), (8, "say . “" + item)]
    numbers = " ".join(str(i) for i in range(30))
    texts += [(20, "Der Hund sah die Katze im Garten neben dem Haus heute früh."), (21, "Der Mann sah die Frau im Wagen neben dem Baum heute früh."), (22, "this is Too SHORT, really"), (23, "What is two plus?"), (24, numbers), (25, numbers.replace("1", "7")), (26, "es waren drei Tage und 5 Stunden bis Rom")]
    items = [(10, item), (11, "too short"), (12, None), (13, " ".join(f"word{i}" for i in range(9))), (14, "Der Mann sah die Frau im Wagen neben dem Baum heute früh."), (15, "What is two plus?"), (16, " ".join(str(i) for i in range(40, 70))), (17, "es waren zwölf Tage und 9 Wochen bis Paris"), (10, item)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_windows"], r["n_matched"]): r["exact"] for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == brute_contamination(texts, items)
    assert {k[0] for k in got} >= {1, 2, None, 7} and {k[0]: v for k, v in got.items()}[2] is False and 3 not in {k[0] for k in got}
    found = {k[:2] for k in got}
    assert {(21, 14), (22, 11), (23, 15), (24, 16), (26, 17)} <= found and (20, 14) not in found
    wide = decontaminate.contaminated(df, bench, bound=0)  # the way for a large benchmark
    assert {(r["doc_id"], r["item_id"], r["n_windows"], r["n_matched"]) for r in wide.collect()} == set(got)
    left = decontaminate.drop_contaminated(df, bench)
    bad = {k[0] for k in got}
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in texts if d not in bad) and {"3", "4", "5", "6", "20"} <= {str(r["doc_id"]) for r in left.collect()}
    odd = df.withColumn("th", F.lit("a")).withColumn("item", F.lit("b")).withColumn("x.y", F.lit("c"))
    kept = decontaminate.drop_contaminated(odd, bench.withColumn("w", F.lit(1)))
    assert kept.columns == odd.columns and kept.count() == left.count()
    long = spark.createDataFrame([(1, "filler words " * 200_000 + item, "en", "s", 0)], SCHEMA)
    assert {r["item_id"] for r in decontaminate.contaminated(long, bench).collect()} == {10}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_planted_benchmark_passages(spark):
    plain = lambda t: " ".join(words(t))
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    planted = {(d["doc_id"], i["item_id"]) for d in docs for i in items if plain(i["text"]) in plain(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_decontamination(spark, SF).collect()}
    assert planted <= got and len(got) <= len(planted) + 2


# --- 10: mixing -------------------------------------------------------------------------------------


def level_targets(sizes):
    """Targets by sharing out and resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(spark, sf, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 2)  # several levels of the tree
    out = mixing.op10_mixing(spark, sf).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = level_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= 3 * largest[s] + 1e-6 for s in want)
    again = mixing.op10_mixing(spark, sf).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_targets_of_many_sources(spark):
    """Sources over many ranges, tied levels, empty sources, a null one: against resharing step by step."""
    rng = random.Random(10)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 7, 7, 7, 90, 1500, 40_000]) for i in range(700)} | {None: 300, "": 12, "é": 5, "z": 1_000_000}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, size long, n long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, common.Scratch(spark)).collect()}
    want = level_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)
    plan = mixing.source_targets(df, common.Scratch(spark))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def pivot_by_hand(docs, level, last):
    """Pivotal rounding of one bucket in exact fractions: (part, size, key) in order of (key, size) -> rounded parts and what is left."""
    from fractions import Fraction

    coin = lambda key, salt: int(common.mix(np.array([(key ^ salt) & (1 << 64) - 1], np.uint64))[0] >> np.uint64(11)) / float(1 << 53)
    docs = sorted(docs, key=lambda d: (d[2], d[1]))
    p, out, held = [Fraction(d[0]) for d in docs], {}, None
    for j, (_, size, key) in enumerate(docs):
        if p[j] < Fraction(1, 10**9) or p[j] > 1 - Fraction(1, 10**9):
            out[j] = round(p[j])
        elif size == 0:
            out[j] = int(coin(key, mixing.SEED + 1000003 * level) < p[j])
        elif held is None:
            held = j
        else:
            i, ratio = held, Fraction(size, docs[held][1])
            up, down = min(1 - p[i], p[j] * ratio), min(p[i], (1 - p[j]) * ratio)
            move = up if coin(key, mixing.SEED + 1000003 * level) * (up + down) < down else -down
            p[i], p[j], held = p[i] + move, p[j] - move / ratio, None
            for k in (i, j):
                if p[k] < Fraction(1, 10**9) or p[k] > 1 - Fraction(1, 10**9):
                    out[k] = round(p[k])
                else:
                    held = k
    if held is not None and last:
        out[held] = int(coin(docs[held][2], mixing.SEED + 1000003 * (level + 500)) < p[held])
        held = None
    return docs, out, held, p


def copies_by_hand(spark, rows, bucket, fan_in):
    """What ``mixing.copies`` should say of rows (source, size, key, n), with exact arithmetic."""
    sizes, docs = Counter(), Counter()
    for s, size, _, n in rows:
        sizes[s] += size * n
        docs[s] += n
    target, out = level_targets(sizes), Counter()
    keys = spark.createDataFrame([(r[2],) for r in rows], "key long")
    where = {r["key"]: r["b"] for r in keys.select("key", F.xxhash64("key", F.lit(mixing.SEED)).alias("b")).collect()}
    levels = 1
    while max(-(-n // bucket) for n in docs.values()) > fan_in ** (levels - 1):
        levels += 1
    for s in sizes:
        buckets, whole = {}, {}
        for _, size, key, n in (r for r in rows if r[0] == s):
            x = target[s] / sizes[s] * n if sizes[s] else 0.0
            x = float(round(x)) if abs(x - round(x)) < 1e-9 else x
            whole[key] = (int(x // 1), size, n)
            buckets.setdefault(where[key] % -(-docs[s] // bucket), []).append((x - x // 1, size, key))
        for level in range(levels):
            later = {}
            for b, group in buckets.items():
                ordered, rounded, held, p = pivot_by_hand(group, level, level == levels - 1)
                for j, y in rounded.items():
                    w, size, n = whole[ordered[j][2]]
                    out[(s, size, ordered[j][2], n, w + y)] += 1
                if held is not None:
                    later.setdefault(b // fan_in, []).append((p[held], *ordered[held][1:]))
            buckets = later
    return out


def test_rounding_against_fractions(spark, monkeypatch):
    """The whole of ``copies`` over a tree of small buckets."""
    rng = random.Random(14)
    rows = [(f"s{rng.choice([0, 0, 0, 1, 2])}", rng.choice([0, 1, 5, 5, 40, 300]), rng.getrandbits(63) - (1 << 62), rng.choice([1, 1, 1, 3])) for _ in range(120)]
    monkeypatch.setattr(mixing, "BUCKET", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = spark.createDataFrame(rows, "source string, size long, key long, n long")
    got = Counter((r["source"], r["size"], r["key"], r["n"], r["copies"]) for r in mixing.copies(df, common.Scratch(spark)).collect())
    assert got == copies_by_hand(spark, rows, 5, 3)


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 200).tolist(), [0.37] * 200
    total, kept = np.zeros(200), 400
    for k in range(kept):
        q = list(p)
        out, held = mixing.pivot(q, size, (rng.integers(-(2**62), 2**62, 200)).tolist(), 0)
        moved = out.astype(float)
        if held >= 0:
            moved[held] = q[held]
        assert abs(np.dot(moved, size) - 0.37 * sum(size)) < 1e-6
        total += moved
    assert abs(total.mean() / kept - 0.37) < 0.02 and abs(total / kept - 0.37).max() < 0.15


def test_mix_documents(spark, docs, empty):
    out = mixing.mix_documents(docs.withColumn("copies", F.lit("clash")))
    assert out.columns == [*docs.columns, "copies"] and mixing.mix_documents(empty).count() == 0
    n = Counter(key(list(r)[:5]) for r in out.collect())
    have = Counter(key(list(r)) for r in docs.collect())
    assert all(n[k] <= 2 * have[k] for k in n)


# --- registered SQL and the pipeline ----------------------------------------------------------------


def test_registered_sql(spark, duck):
    from fieldloom.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert same(queries.QUERIES[name](spark, SF), duck.sql(sql))


def votes_of(text):
    """Votes of the rules in plain Python."""
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = base_measures(text)
    alnum = lambda c: unicodedata.category(c)[0] in "LMN"
    marked = lambda x: any(not alnum(a) and not alnum(b) for a, b in zip(x, x[1:])) or not any(map(alnum, x))
    m = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": len(lines),
        "n_caps": sum(x == x.upper() and x != x.lower() for x in w), "n_exclaim": (text or "").count("!"), "n_marked": sum(map(marked, w)), "n_distinct": len(set(w)),
    }
    true = lambda rule: eval(rule.replace(" AND ", " and ").replace(" OR ", " or ").replace(" = ", " == "), {}, m)
    return tuple(-1 if true(bad) else 1 if true(good) else 0 for bad, good in quality_rules.RULES.values()), true(quality_rules.BASE_FAILED.replace("OR", "or"))


def shards_by_hand(rows, limit):
    """(row, shard_id, bytes of the shard) by splitting bucket by bucket."""
    bits = lambda r: format(int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16), "060b")
    out, todo = [], [("", rows)]
    while todo:
        prefix, part = todo.pop()
        size = sum(len((r[1] or "").encode()) for r in part)
        if size <= limit:
            out += [(r, prefix, size) for r in part]
        else:
            todo += [(prefix + x, [r for r in part if bits(r)[len(prefix)] == x]) for x in "01"]
    return out


def test_pipeline_by_brute_force(spark, rows, tmp_path):
    """Every stage, and all together, on documents with planted items and junk, against plain Python."""
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    more = [(200 + i, passage(rng, 30) + ". " + x + " " + passage(rng, 30), "en", f"s{i % 4}") for i, x in enumerate(items)]
    more += [(300 + i, " | ".join(passage(rng, 60).split()) + " %%%", "en", "s1") for i in range(9)] + [(400 + i, passage(rng, 4) + " " + ("BUY!! NOW!! " + passage(rng, 3).upper() + "!! ") * 9, "en", "s2") for i in range(9)]
    every = rows + [(d, t, l, s, len(t)) for d, t, l, s in more]
    spark.createDataFrame(every, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def stage(k, now):
        out = pipeline.STAGES[k][1](spark, spark.createDataFrame(now, SCHEMA) if k else docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        return [tuple(r) for r in out.collect()]

    voted = [votes_of(r[1]) for r in every]
    posterior, _ = estimate(Counter(v for v, _ in voted))
    good = [r for r, (v, failed) in zip(every, voted) if not failed and posterior[v] >= 0.5]
    assert Counter(stage(0, every)) == Counter(good) and len([r for r in every if (r[0] or 0) >= 300]) > 10 and not [r for r in good if (r[0] or 0) >= 300]
    found = brute_components([(i, print_of(r[1])) for i, r in enumerate(good)])
    groups = {}
    for r, c in zip(good, found):
        groups.setdefault(c, []).append(r)
    unique = stage(1, good)
    assert len(unique) == len(groups) and len(unique) < len(good)
    for group in groups.values():
        own = [r for r in unique if r in group]
        assert len(own) == 1 and own[0][0] == min((r[0] for r in group), key=lambda d: (d is None, d or 0))
    bad = {d for d, *_ in brute_contamination([(r, r[1]) for r in unique], list(enumerate(items)))}
    clean = stage(2, unique)
    assert Counter(clean) == Counter(r for r in unique if r not in bad) and {r[0] for r in bad} == {200, 201, 202, 203}
    df = spark.createDataFrame(clean, SCHEMA)
    keys = [r[0] for r in df.select(F.xxhash64(*df.columns)).collect()]
    taken = copies_by_hand(spark, [(r[3], len(words(r[1])), k, 1) for r, k in zip(clean, keys)], mixing.BUCKET, mixing.FAN_IN)
    at = dict(zip(keys, clean))
    mixed = [at[key] for (_, _, key, _, n), times in taken.items() for _ in range(n * times)]
    assert Counter(stage(3, clean)) == Counter(mixed) and len(mixed) > len(clean)
    size = lambda r: len((r[1] or "").encode())
    want = Counter((r, b, n) for r, b, n in shards_by_hand(mixed, sharding.LIMIT))
    assert Counter((r[:5], r[5], r[8]) for r in stage(4, mixed)) == want and sum(map(size, mixed)) > 0
    whole = pipeline.run(spark, str(tmp_path))
    assert whole.columns == [*docs.columns, "shard_id", "depth", "overflow", "shard_bytes", "shard_docs"]
    assert Counter((tuple(r)[:5], r["shard_id"], r["shard_bytes"]) for r in whole.collect()) == want


def test_pipeline_edges(spark, rows, tmp_path):
    """No rows at all; null ids, and columns whose names are those of helpers."""
    import corpus_pipeline as pipeline

    odd = spark.createDataFrame(rows, SCHEMA)
    for name in ("_row", "_k1", "key", "copies", "Depth", "votes", "th", "a.b"):
        odd = odd.withColumn(name, F.lit("x"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    out = pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == [*odd.columns, "shard_id", "depth_", "overflow", "shard_bytes", "shard_docs"]
    got = out.collect()
    assert None in {r["doc_id"] for r in got} or not [r for r in rows if r[0] is None and len(words(r[1])) >= 10]
    assert all(r["a.b"] == "x" and r["Depth"] == "x" for r in got) and len(got) > 10
    assert pipeline.run(spark, f"{tmp_path}/b").count() == 0
