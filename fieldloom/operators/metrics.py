"""Scores of predictions, correlations, zonal summaries, tiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators.stats import join_keys, linear_quantiles, running


def rmse(obs: str = "obs", pred: str = "pred") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(obs) - F.col(pred), 2)))


def regression_metrics(df: DataFrame, by: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """``by`` and r2, pearsonr, rmse, nrmse (by the 1 to 99 % range of obs), mse, mae, medae."""
    e = F.col(obs) - F.col(pred)
    mse = F.avg(e * e)
    plain = df.groupBy(*by).agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(obs) * F.count(e))).alias("r2"), F.corr(obs, pred).alias("pearsonr"), F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(e)).alias("mae"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("_w"), F.col(obs).cast("double").alias("_x")), F.struct(F.lit(1).alias("_w"), F.abs(e).cast("double").alias("_x"))))
    long = df.select(*by, both.alias("_s")).select(*by, "_s.*")  # observations and errors in one pass
    q = linear_quantiles(long, [*by, "_w"], "_x", {"_a": 0.01, "_b": 0.5, "_c": 0.99})
    ranks = q.groupBy(*by).agg(F.max(F.when(F.col("_w") == 0, F.col("_c") - F.col("_a"))).alias("_spread"), F.max(F.when(F.col("_w") == 1, F.col("_b"))).alias("medae"))
    joined = join_keys(plain, ranks, by) if by else plain.crossJoin(F.broadcast(ranks))  # one row
    return joined.withColumn("nrmse", F.try_divide(F.col("rmse"), F.col("_spread"))).select(*by, *METRICS)


METRICS = ("r2", "pearsonr", "rmse", "nrmse", "mse", "mae", "medae")


def foldwise(df: DataFrame, fold: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean and std over folds of each metric."""
    per = regression_metrics(df, [*by, fold])
    return per.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    """Closed form over one aggregation."""
    sw, mx, my = F.sum(w), F.sum(w * x) / F.sum(w), F.sum(w * y) / F.sum(w)
    cov = F.sum(w * x * y) / sw - mx * my
    return cov / F.sqrt((F.sum(w * x * x) / sw - mx * mx) * (F.sum(w * y * y) / sw - my * my))


def area_weight(lat: Column, size: float) -> Column:
    """Cell area relative to the equator's."""
    return geo.zone_area(lat, size) / geo.zone_area(F.lit(0.0), size)


def inside_share(df: DataFrame, by: list[str], flag: str = "aoa") -> DataFrame:
    """Share inside the area of applicability: the flag says outside."""
    return df.groupBy(*by).agg((1 - F.avg(F.col(flag).cast("int"))).alias("aoa_frac"))


def global_fraction(flag: Column, literal: bool = True) -> Column:
    """1 - (count of 1 / count of 0) as published, or over all flags."""
    ones, zeros = F.count_if(flag == 1), F.count_if(flag == 0)
    return 1 - F.try_divide(ones, zeros if literal else ones + zeros)


def majority(df: DataFrame, by: list[str], flag: str, n: int) -> DataFrame:
    """1 where at least half of n layers have the flag; null if any layer has none."""
    return df.groupBy(*by).agg(F.when(F.count(flag) == F.count(F.lit(1)), (F.sum(flag) >= n / 2).cast("int")).alias("majority"))


def difference(a: DataFrame, b: DataFrame, by: list[str], flag: str) -> DataFrame:
    """1 where only ``a`` has the flag, -1 where only ``b`` has, 0 where both agree; null where either has none."""
    x, y = a.select(*by, F.col(flag).alias("_x")), b.select(*by, F.col(flag).alias("_y"))
    return x.join(y, by, "full").select(*by, (F.col("_x") - F.col("_y")).alias("difference"))


def tiers(df: DataFrame, metric: str, name: str, top: float = 0.3, middle: float = 0.7) -> DataFrame:
    """Tier of each model by rank, the highest first, with floor() cut-offs; null scores come last."""
    low = F.coalesce(-F.col(metric).cast("double"), F.lit(float("inf")))
    ranked = running(df.withColumn("_low", low), "_low", [F.col(name)], {"_r": F.lit(1)})
    n, r = F.col("_r_all"), F.col("_r")
    return ranked.withColumn("tier", F.when(r <= F.floor(n * top), "high").when(r <= F.floor(n * middle), "medium").otherwise("low")).drop("_low", "_r", "_r_all")


#: Two-sided 97.5 % points of Student's t for 1 to 10 degrees of freedom.
T975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)


def error_bar(std: Column, n: Column, interval: bool = True) -> Column:
    """Half width of a 95 % interval of the mean over n folds, or the std itself."""
    if not interval:
        return std
    t = F.element_at(F.array(*[F.lit(x) for x in T975]), F.least(F.greatest(n - 1, F.lit(1)), F.lit(10)).cast("int"))
    return F.when(n > 1, t * std / F.sqrt(n))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample p-value; 0 if a sample is empty."""
    if not n or not m:
        return 0.0
    en = math.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def t_within(t: float, df: int) -> float:
    """Share of Student's distribution with whole degrees of freedom between -t and t: its finite series."""
    theta = math.atan(abs(t) / math.sqrt(df))
    sin, cos = math.sin(theta), math.cos(theta)
    term, total = (cos, 0.0) if df % 2 else (1.0, 0.0)
    for k in range((df - 1) // 2 if df % 2 else df // 2):
        total += term
        term *= cos * cos * ((2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2))
    return 2 / math.pi * (theta + sin * total) if df % 2 else sin * total


def t_critical(share: float, df: int) -> float:
    """The t between whose negative and itself ``share`` of the distribution lies."""
    low, high = 0.0, 1.0
    while t_within(high, df) < share:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_within(mid, df) < share else (low, mid)
    return (low + high) / 2


def one_sided(values: list[float], share: float = 0.99) -> tuple[float, float | None, int, float | None, float | None, float | None]:
    """(mean, std, n, p of a mean not above 0, low and high end of the interval of ``share``); a single value has no std, p or interval."""
    n, mean = len(values), sum(values) / len(values)
    if n < 2:
        return mean, None, n, None, None, None
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
    half = t_critical(share, n - 1) * std / math.sqrt(n)
    inside = t_within(mean / (std / math.sqrt(n)), n - 1) if std > 0 else float(mean != 0)
    return mean, std, n, (1 - math.copysign(inside, mean)) / 2, mean - half, mean + half


def ks_statistic(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """(d, n, m): the largest distance of two empirical distributions. Equal values are counted together first."""
    at = df.filter(F.col(group).isin(a, b)).groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    steps = running(at, value, [], {"a": F.col("na"), "b": F.col("nb")})
    d = F.abs(F.col("a") / F.col("a_all") - F.col("b") / F.col("b_all"))
    return steps.agg(F.max(d).alias("d"), F.max("a_all").cast("long").alias("n"), F.max("b_all").cast("long").alias("m"))


def ks_p_column(d: Column, n: Column, m: Column) -> Column:
    """:func:`ks_p_value` as an expression."""
    en = F.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when((n == 0) | (m == 0), 0.0).when(x <= 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def similarity(ks: Column, balanced: Column, weight: float = 0.5) -> Column:
    """Score of a deal of folds: ``weight`` of the likeness of distributions, the rest of the balance of sizes."""
    return weight * ks + (1 - weight) * balanced


def balance(df: DataFrame, fold: str, k: int) -> DataFrame:
    """1 / (1 + std / mean) of fold sizes, folds without rows included."""
    counts = df.groupBy(F.col(fold).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.range(k).join(counts, "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return full.agg((1 / (1 + F.stddev_pop("n") / F.avg("n"))).alias("balance"))
