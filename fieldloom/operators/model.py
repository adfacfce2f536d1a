"""Transforms with fitted parameters, fold assignment, model protocol, applicability."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.power import yeo_johnson, yeo_johnson_inverse, yeo_johnson_np
from fieldloom.operators import metrics
from fieldloom.operators.stats import linear_quantiles, seeded, shuffled

# --- column transforms ------------------------------------------------------------------------------


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std, from one aggregation."""
    stats = F.broadcast(df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]))  # one row
    return df.crossJoin(stats).select(*[((F.col(c) - F.col(f"{c}_m")) / F.nullif(F.col(f"{c}_s"), F.lit(0.0))).alias(c) if c in columns else F.col(c) for c in df.columns])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = F.broadcast(df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("l", F.min), ("h", F.max))]))  # one row
    return df.crossJoin(stats).select(*[((F.col(c) - F.col(f"{c}_l")) / F.nullif(F.col(f"{c}_h") - F.col(f"{c}_l"), F.lit(0))).alias(c) if c in columns else F.col(c) for c in df.columns])


def log_transform(df: DataFrame, columns: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """log1p of the columns under the suffix ``_ln``, originals dropped; columns in ``keep`` stay as they are."""
    chosen = [c for c in columns if c not in keep]
    return df.select(*[c for c in df.columns if c not in chosen], *[F.log1p(c).alias(f"{c}_ln") for c in chosen])


def _moments(counted: DataFrame, trait: str, grids: dict[str | None, np.ndarray]) -> pd.DataFrame:
    """Per trait of ``grids``: number of values, the Jacobian's sum, and mean and squared deviations of the values moved by each lambda of its grid.

    Parts of a partition are merged by trait, and only one row a trait goes to the driver."""
    schema = f"{trait} string, n double, jac double, mean array<double>, dev array<double>"

    def part(batches):
        for pdf in batches:
            rows = []
            for name, g in pdf.groupby(trait, dropna=False, sort=False):
                name = None if pd.isna(name) else name
                if name in grids:
                    x, w = g["_x"].to_numpy(float), g["_n"].to_numpy(float)
                    n, mean, dev = w.sum(), [], []
                    for lam in grids[name]:
                        y = yeo_johnson_np(x, lam)
                        mean.append(float((w * y).sum() / n))
                        dev.append(float((w * (y - mean[-1]) ** 2).sum()))
                    rows.append((name, n, float((w * np.sign(x) * np.log1p(np.abs(x))).sum()), mean, dev))
            yield pd.DataFrame(rows, columns=[trait, "n", "jac", "mean", "dev"])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        n, means = g["n"].to_numpy(float), np.stack(g["mean"].to_list())
        mean = (n[:, None] * means).sum(0) / n.sum()
        dev = np.stack(g["dev"].to_list()).sum(0) + (n[:, None] * (means - mean) ** 2).sum(0)
        return pd.DataFrame({trait: [g[trait].iloc[0]], "n": [n.sum()], "jac": [g["jac"].sum()], "mean": [mean], "dev": [dev]})

    return counted.mapInPandas(part, schema).groupBy(trait).applyInPandas(merge, schema).toPandas()


def fit_lambdas(long: DataFrame, trait: str, value: str, low: float = -3.0, high: float = 5.0) -> dict[str | None, float]:
    """Maximum-likelihood lambda of each trait over all its finite values: grids of lambdas, each a fortieth as wide as the last, at one pass over (value, count) a grid."""
    x = F.col(value).cast("double")
    counted = long.select(F.col(trait).cast("string").alias(trait), x.alias("_x")).filter(F.abs("_x") < float("inf")).groupBy(trait, "_x").agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        kinds = counted.groupBy(trait).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).collect()  # one row a trait
        out = {r[trait]: 1.0 for r in kinds}
        grids = {r[trait]: np.linspace(low, high, 81) for r in kinds if r["k"] > 1}
        width = (high - low) / 80
        while grids and width > 1e-8:
            for r in _moments(counted, trait, grids).itertuples(index=False):
                name, n, jac, _, dev = r
                name = None if pd.isna(name) else name
                var = np.asarray(dev, float) / n
                with np.errstate(divide="ignore", invalid="ignore"):
                    loss = np.where(np.isfinite(var) & (var > 0), n / 2 * np.log(var) - (grids[name] - 1) * jac, np.inf)
                out[name] = float(grids[name][int(np.argmin(loss))])
            grids = {t: np.clip(np.linspace(out[t] - width, out[t] + width, 81), low, high) for t in grids}
            width /= 40
        return out
    finally:
        counted.unpersist()


def fit_power(long: DataFrame, trait: str = "trait", value: str = "value", gate: float = 0.0) -> DataFrame:
    """Parameter table (trait, lambda, mean, scale, transformed): lambda by maximum likelihood on all values.

    A trait whose std / |mean| is under ``gate`` is left as it is, with lambda 1."""
    stats = long.groupBy(trait).agg((F.stddev_samp(value) / F.abs(F.avg(value))).alias("cv"))
    fits = long.sparkSession.createDataFrame(list(fit_lambdas(long, trait, value).items()), f"{trait} string, fitted double")
    params = fits.join(stats, trait).select(trait, F.when(F.col("cv") >= gate, F.col("fitted")).otherwise(1.0).alias("lambda"), (F.col("cv") >= gate).alias("transformed"))
    moved = long.join(params, trait).withColumn("_y", F.when(F.col("transformed"), yeo_johnson(F.col(value).cast("double"), F.col("lambda"))).otherwise(F.col(value)))
    return moved.groupBy(trait, "lambda", "transformed").agg(F.avg("_y").alias("mean"), F.stddev_pop("_y").alias("scale"))


def apply_power(long: DataFrame, params: DataFrame, trait: str = "trait", value: str = "value", inverse: bool = False) -> DataFrame:
    f = yeo_johnson_inverse if inverse else yeo_johnson
    return long.join(params.select(trait, "lambda", "transformed"), trait).withColumn(value, F.when(F.col("transformed"), f(F.col(value).cast("double"), F.col("lambda"))).otherwise(F.col(value))).drop("lambda", "transformed")


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {"log": log_transform, "norm": standardise, "minmax": min_max}


def transform(df: DataFrame, how: str | None, columns: list[str]) -> DataFrame:
    if how is None:
        return df
    if how not in TRANSFORMS:
        raise ValueError(f"unknown transform {how!r}")
    return TRANSFORMS[how](df, columns)


def pca(df: DataFrame, vector: str, components: int | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as rows, explained shares) from one aggregation of the Gram matrix: its size is that of the vector, not of the data.

    ``components`` below 1 asks for that share of variance. Each component's largest loading is positive."""
    d = len(df.select(vector).first()[0])

    def gram(batches):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_list()).astype(float)
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    rows = df.select(vector).mapInPandas(gram, "n long, s array<double>, g array<double>")
    flat = rows.select("n", F.posexplode(F.concat("s", "g")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    total = {r["i"]: r["v"] for r in flat.collect()}  # d + d * d numbers
    n = rows.agg(F.sum("n")).first()[0]
    mean = np.array([total[i] for i in range(d)]) / n
    cov = (np.array([total[d + i] for i in range(d * d)]).reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    share = values / values.sum()
    k = int(components) if components >= 1 else int(np.searchsorted(np.cumsum(share), components - 1e-12) + 1)
    rows_ = vectors[:k]
    signs = np.sign(rows_[np.arange(len(rows_)), np.abs(rows_).argmax(1)])
    return mean, rows_ * signs[:, None], share[:k]


def loadings(rows: np.ndarray, names: list[str], k: int) -> list[tuple[int, str, float]]:
    """(component, name, loading): the ``k`` largest by absolute value of each component."""
    return [(i + 1, names[j], float(r[j])) for i, r in enumerate(rows) for j in np.argsort(-np.abs(r), kind="stable")[:k]]


def reconstruct(df: DataFrame, vector: str, mean: np.ndarray, rows: np.ndarray) -> DataFrame:
    """One row: mean squared error of the vector rebuilt from its components."""
    shadow = rows.T @ rows  # projector, as large as the vector squared

    def run(batches):
        for pdf in batches:
            c = _matrix(pdf[vector]) - mean if len(pdf) else np.zeros((0, len(mean)))
            yield pd.DataFrame({"s": [float(((c - c @ shadow) ** 2).sum())], "n": [c.size]})

    return df.select(vector).mapInPandas(run, "s double, n long").agg((F.sum("s") / F.sum("n")).alias("mse"))


def project(df: DataFrame, vector: str, mean: np.ndarray, rows: np.ndarray) -> DataFrame:
    """Adds pc1, pc2, ... as expressions on the array."""
    out = df
    for i, r in enumerate(rows, 1):
        terms = F.zip_with(F.col(vector), F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(w)).alias("w")) for m, w in zip(mean, r)]), lambda x, p: (x - p["m"]) * p["w"])
        out = out.withColumn(f"pc{i}", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return out


# --- folds ------------------------------------------------------------------------------------------


def assign_folds(cells: DataFrame, key: str, size: str, k: int, sims: int) -> DataFrame:
    """(key, fold): of ``sims`` seeded deals of cells into k equal sets, the one whose row counts are most balanced.

    Only cells take part, one row each with its number of rows."""
    deals = cells.select(key, size).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    deals = deals.withColumn("fold", F.ntile(k).over(Window.partitionBy("sim").orderBy(shuffled(key, "sim"), key)) - 1)
    per = deals.groupBy("sim", "fold").agg(F.sum(size).alias("n")).groupBy("sim").agg(F.round(1 / (1 + F.stddev_pop("n") / F.avg("n")), 12).alias("score"))
    best = F.broadcast(per.agg(F.max_by("sim", F.struct("score", (-F.col("sim")).alias("s"))).alias("sim")))  # one row
    return deals.join(best, "sim", "left_semi").select(key, "fold")


def pick_range(table: dict[str, float], custom: float | None = None, strategy: str = "per_trait", trait: str | None = None, stat: str | None = None) -> float:
    """Blocking range: a custom one, else that of ``stat`` (an older setting, a summary over all traits), else the trait's own or a summary, by ``strategy``."""
    if custom is not None:
        return custom
    strategy = stat or strategy
    if strategy == "per_trait":
        if trait not in table:
            raise ValueError(f"no range for trait {trait!r}")
        return table[trait]
    return {"mean": np.mean, "median": np.median, "min": np.min, "max": np.max}[strategy](list(table.values()))


# --- models -----------------------------------------------------------------------------------------


def _learner(label: str, weight: str | None, seed: int, heavy: bool):
    from pyspark.ml.regression import GBTRegressor

    args = {"featuresCol": "_features", "labelCol": label, "predictionCol": "pred", "seed": seed, "maxIter": 20 if heavy else 8, "maxDepth": 5 if heavy else 4}
    return GBTRegressor(**args, **({"weightCol": weight} if weight else {}))


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def train_fold(df: DataFrame, features: list[str], label: str, fold: str, k: int, weight: str | None = None, source: str | None = None, seed: int = 42):
    """(model, predictions of fold k): trained on the other folds; validated on plot rows only, if a source column is named."""
    rows = _vector(df, features)
    model = _learner(label, weight, seed, False).fit(rows.filter(F.col(fold) != k))
    val = rows.filter(F.col(fold) == k)
    return model, model.transform(val.filter(F.col(source) == "s") if source else val).drop("_features")


def fold_ids(df: DataFrame, fold: str) -> list:
    return sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)  # as many as folds


def cross_validate(df: DataFrame, features: list[str], label: str, fold: str, weight: str | None = None, source: str | None = None, seed: int = 42) -> DataFrame:
    """(fold, metrics): scores of each fold's model on the rows of that fold, and their mean and std over folds in rows 'mean' and 'std'."""
    preds = [train_fold(df, features, label, fold, k, weight, source, seed)[1].select(F.col(fold).cast("string").alias("fold"), F.col(label).alias("obs"), "pred") for k in fold_ids(df, fold)]
    per = metrics.regression_metrics(reduce(DataFrame.unionByName, preds).persist(), ["fold"])  # predictions are read for sums and for ranks
    rows = per.select(F.explode(F.array("fold", F.lit("mean"), F.lit("std"))).alias("fold"), *metrics.METRICS)
    return rows.groupBy("fold").agg(*[F.when(F.col("fold") == "std", F.stddev_samp(m)).otherwise(F.avg(m)).alias(m) for m in metrics.METRICS])


def train_full(df: DataFrame, features: list[str], label: str, weight: str | None = None, seed: int = 42):
    """One model on all rows; a heavier one for small data."""
    return _learner(label, weight, seed, df.count() < 30_000).fit(_vector(df, features))


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_vector(df, features)).drop("_features")


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values by the column's exact median; a column without values stays empty."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])).alias("_s")).select("_s.*")
    per = linear_quantiles(long, ["_c"], "_x", {"_m": 0.5})
    one = F.broadcast(per.agg(*[F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(f"_m{i}") for i in range(len(columns))]))  # one row
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m{i}")).alias(c) for i, c in enumerate(columns)}
    return df.crossJoin(one).select(*[filled.get(c, F.col(c)) for c in df.columns])


def impute_by_model(df: DataFrame, columns: list[str], features: list[str], seed: int = 42) -> DataFrame:
    """Missing values of each of ``columns`` by trees over the other columns ``features``, fitted on the rows that have it; gaps in features are filled by medians for that."""
    if both := set(columns) & set(features):
        raise ValueError(f"columns that are features too: {sorted(both)}")
    whole = [f"_f{i}" for i in range(len(features))]
    out = impute(df.select("*", *[F.col(f).cast("double").alias(n) for f, n in zip(features, whole)]), whole)
    for c in columns:
        fitted = train_full(out.filter(F.col(c).isNotNull()), whole, c, seed=seed)
        out = predict(fitted, out, whole).withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("pred"))).select(*df.columns, *whole)
    return out.select(*df.columns)


def permutation_importance(model, df: DataFrame, features: list[str], groups: dict[str, list[str]], label: str, key: str, rounds: int = 3) -> DataFrame:
    """(feature, importance, stddev, n, p_value, p99_low, p99_high): rise of the rmse when a group of features is shuffled among rows,
    with the one-sided p of no rise and the 99 % interval of the mean over rounds.

    The shuffle pairs rows by their rank under two seeded orders within blocks, so that nothing goes through one task."""
    base = predict(model, df, features).agg(metrics.rmse(label)).first()[0]
    scores = []
    blocks = F.pmod(F.xxhash64(key), F.lit(16))
    for name, own in groups.items():
        for r in range(rounds):
            at = df.withColumn("_b", blocks).withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(seeded(key, seed=1), key)))
            other = df.select(blocks.alias("_b"), F.row_number().over(Window.partitionBy(blocks).orderBy(seeded(key, seed=1000 + r), key)).alias("_i"), *own)
            mixed = at.drop(*own).join(other, ["_b", "_i"])
            scores.append((name, float(predict(model, mixed, features).agg(metrics.rmse(label)).first()[0] - base)))
    stats = [(name, *metrics.one_sided([d for n, d in scores if n == name])) for name in groups]
    return df.sparkSession.createDataFrame(stats, "feature string, importance double, stddev double, n long, p_value double, p99_low double, p99_high double")


def fold_importance(df: DataFrame, features: list[str], groups: dict[str, list[str]], label: str, fold: str, key: str, rounds: int = 3, weight: str | None = None, source: str | None = None) -> DataFrame:
    """:func:`permutation_importance` of each fold's model on the rows that it has not seen."""
    out = []
    for k in fold_ids(df, fold):
        m, val = train_fold(df, features, label, fold, k, weight, source)
        out.append(permutation_importance(m, val.drop("pred"), features, groups, label, key, rounds).select(F.lit(k).alias("fold"), "*"))
    return reduce(DataFrame.unionByName, out)


def coefficient_of_variation(predictions: DataFrame, by: list[str], value: str) -> DataFrame:
    """std / mean over folds, with all values shifted by the absolute global minimum."""
    shift = F.broadcast(predictions.agg(F.abs(F.min(value)).alias("_c")))  # one row
    moved = predictions.crossJoin(shift).withColumn("_v", F.col(value) + F.col("_c"))
    return moved.groupBy(*by).agg(F.try_divide(F.stddev_samp("_v"), F.avg("_v")).alias("cov"))


# --- applicability ----------------------------------------------------------------------------------


def scaled_features(df: DataFrame, vector: str, weights: list[float] | None = None) -> DataFrame:
    """The vector as z-scores (sample std) times importance weights; moments from one aggregation by position."""
    moments = df.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    packed = F.broadcast(moments.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("_z")))  # one row, as long as the vector
    z = F.zip_with(vector, "_z", lambda v, p: (v - p["m"]) / F.nullif(p["s"], F.lit(0.0)))
    if weights:
        z = F.zip_with(z, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w)
    return df.crossJoin(packed).withColumn(vector, z).drop("_z")


#: Training vectors up to which they travel to every task; beyond that, blocks of as many meet blocks of the other side.
TRAIN_BOUND = 20_000


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def _squared(part: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((part * part).sum(1)[:, None] + (x * x).sum(1) - 2 * part @ x.T, 0)


def _nearest(own: pd.DataFrame, x: np.ndarray, f: np.ndarray | None, keep: list[str], vector: str, fold: str | None) -> pd.DataFrame:
    """Least distance of each row to ``x``, for each other fold if folds are given, in steps of 512 rows."""
    v, out = _matrix(own[vector]), []
    for lo in range(0, len(v), 512):
        d = np.sqrt(_squared(v[lo : lo + 512], x))
        rows = own.iloc[lo : lo + 512]
        for other in np.unique(f) if fold else (None,):
            take = (rows[fold].to_numpy() != other) if fold else np.ones(len(rows), bool)
            best = d[:, f == other].min(1) if fold else d.min(1)
            out.append(rows.loc[take, keep].assign(dist=best[take], **({"other": other} if fold else {})))
    return pd.concat(out) if out else own[keep].assign(dist=0.0, **({"other": 0} if fold else {}))


def _paired(df: DataFrame, train: DataFrame, key: str, n: int, run, schema: str) -> DataFrame:
    """``run(left, right)`` on every pair of a block of ``df`` and a block of ``train``, each of bounded size: the price of an exact search without an index."""
    blocks = -(-n // TRAIN_BOUND)
    parts = max(1, -(-df.count() // TRAIN_BOUND))
    left = df.withColumn("_p", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = train.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(2)), F.lit(blocks)).cast("int")).withColumn("_p", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    left = left.withColumn("_p", F.col("_p").cast("bigint"))
    return left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInPandas(run, schema)


def nearest_distance(df: DataFrame, train: DataFrame, key: str, vector: str, fold: str | None = None, bound: int | None = None) -> DataFrame:
    """Exact distance of each row to the nearest training vector; with ``fold``, one row for each other fold."""
    keep = [key, fold] if fold else [key]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep) + ", dist double" + (", other int" if fold else "")
    train, n = train.select(key, vector, *([fold] if fold else [])), train.count()
    if n <= (TRAIN_BOUND if bound is None else bound):
        rows = train.collect()  # checked bound
        x, f = _matrix([r[vector] for r in rows]), np.array([r[fold] for r in rows]) if fold else None

        def stream(batches):
            for pdf in batches:
                yield _nearest(pdf, x, f, keep, vector, fold)

        return df.select(*keep, vector).mapInPandas(stream, schema)

    def pair(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return own[keep].iloc[:0].assign(dist=0.0, **({"other": 0} if fold else {}))
        return _nearest(own, _matrix(other[vector]), other[fold].to_numpy() if fold else None, keep, vector, fold)

    near = _paired(df.select(*keep, vector), train, key, n, pair, schema)
    return near.groupBy(*keep, *(["other"] if fold else [])).agg(F.min("dist").alias("dist")).select(*keep, "dist", *(["other"] if fold else []))


def mean_distance(train: DataFrame, key: str, vector: str, bound: int | None = None) -> DataFrame:
    """One row: mean distance over all ordered pairs, self-pairs included."""
    train, n = train.select(key, vector), train.count()
    total = lambda part, x: float(np.sqrt(np.where((d := _squared(part, x)) < 1e-9, 0, d)).sum())
    steps = lambda v, x: pd.DataFrame({"s": [sum(total(v[lo : lo + 512], x) for lo in range(0, len(v), 512))], "n": [len(v) * len(x)]})
    if n <= (TRAIN_BOUND if bound is None else bound):
        x = _matrix([r[vector] for r in train.collect()])  # checked bound

        def stream(batches):
            for pdf in batches:
                yield steps(_matrix(pdf[vector]), x)

        sums = train.mapInPandas(stream, "s double, n long")
    else:
        sums = _paired(train, train, key, n, lambda a, b: steps(_matrix(a[vector]), _matrix(b[vector])) if len(a) and len(b) else pd.DataFrame({"s": [0.0], "n": [0]}), "s double, n long")
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean_distance"))


def di_threshold(distances: DataFrame, mean: DataFrame, dist: str = "dist") -> DataFrame:
    """One row: (q75 + 1.5 * iqr) of pooled nearest distances, over the mean distance."""
    q = linear_quantiles(distances.select(dist).persist(), [], dist, {"q75": 0.75, "q25": 0.25})  # distances are read for cut points and for ranks
    return q.crossJoin(F.broadcast(mean)).select(((F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))) / F.col("mean_distance")).alias("threshold"))


def applicability(distances: DataFrame, mean: DataFrame, threshold: DataFrame, inverted: bool = False) -> DataFrame:
    """Adds di and aoa, where aoa is true OUTSIDE of the area; ``inverted``: inside of it, as some analyses have it. The two are not to be mixed."""
    one = F.broadcast(mean.crossJoin(F.broadcast(threshold)))  # one row
    return distances.crossJoin(one).withColumn("di", F.col("dist") / F.col("mean_distance")).withColumn("aoa", F.col("di") <= F.col("threshold") if inverted else F.col("di") > F.col("threshold")).drop("mean_distance", "threshold")
