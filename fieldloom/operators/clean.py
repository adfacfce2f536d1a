"""Filters, outlier treatment, survey weights, harmonisation: rows in, rows out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import names
from fieldloom.operators.stats import dominant_category, join_keys, linear_quantiles, running


def filter_types(df: DataFrame, column: str, wanted: str, valid: set[str]) -> DataFrame:
    """Rows of the plant types in an underscore-joined list; error if none of them is valid."""
    types = [t for t in wanted.split("_") if t in valid]
    if not types:
        raise ValueError(f"no valid type in {wanted!r}")
    return df.filter(F.col(column).isin(types))


def drop_sparse(df: DataFrame, columns: list[str], missing_share: float) -> DataFrame:
    """Rows with at least ceil(n * (1 - missing_share)) of ``columns`` present."""
    return df.dropna(thresh=math.ceil(len(columns) * (1 - missing_share)), subset=columns)


def drop_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows other than ``value``; a null is other."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def bounds(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """One row of exact linear quantile bounds ``{c}_lo``, ``{c}_hi``, of all columns in one pass over (column, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])).alias("_s")).select("_s.*")
    per = linear_quantiles(long, ["_c"], "_x", {"lo": low, "hi": high})
    return per.agg(*[F.max(F.when(F.col("_c") == i, F.col(n))).alias(f"{c}_{n}") for i, c in enumerate(columns) for n in ("lo", "hi")])


def drop_outliers(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Rows inside the inclusive bounds of all columns; a null is outside."""
    b = F.broadcast(bounds(df, columns, low, high))  # one row
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    return df.crossJoin(b).filter(inside).select(*df.columns)


def null_outliers(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Cells strictly outside their column's bounds become null; rows stay."""
    b = F.broadcast(bounds(df, columns, low, high))  # one row
    return df.crossJoin(b).select(*[F.when(F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi")), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def min_observations(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys that have at least ``n`` rows."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(key), key, "left_semi")


def resurvey_weight(df: DataFrame, by: list[str], year: str) -> DataFrame:
    """Adds n_years and weight: 1 for at most one year, else 1 / years; a group with a null key has neither."""
    counts = df.dropna(subset=by).groupBy(*by).agg(F.countDistinct(year).alias("n_years"))
    out = df.join(counts, by, "left")
    return out.withColumn("weight", F.when(F.col("n_years") <= 1, F.lit(1.0)).otherwise(1.0 / F.col("n_years")))


def flag_weight(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Adds weight 1 / (resurveys of the group + 1) to flagged rows, 1 to others."""
    counts = df.groupBy(*by).agg(F.sum(F.col(flag).cast("int")).alias("_n"))
    out = join_keys(df, counts, by)
    return out.withColumn("weight", F.when(F.col(flag), 1.0 / (F.col("_n") + 1)).otherwise(F.lit(1.0))).drop("_n")


def gate_by_sum(df: DataFrame, key: str, value: str, at_least: float) -> DataFrame:
    """Rows of groups whose values sum up to ``at_least``."""
    keep = df.groupBy(key).agg(F.sum(value).alias("_s")).filter(F.col("_s") >= at_least).select(key)
    return df.join(keep, key, "left_semi")


def harmonise(traits: DataFrame, lookup: DataFrame, on: str, name: str) -> DataFrame:
    """Left join with a look-up table, reduced to one row a key first; rows of ``traits`` never multiply."""
    one = lookup.groupBy(on).agg(F.min(name).alias(name))
    return traits.join(one, on, "left")


def fill_by_genus(df: DataFrame, species: str, category: str, threshold: float) -> DataFrame:
    """Missing categories filled by the dominant one of the genus, where its share reaches ``threshold``."""
    rows = df.withColumn("_genus", names.genus(F.col(species)))
    top = dominant_category(rows.filter(F.col(category).isNotNull()), "_genus", category, threshold).withColumnRenamed(category, "_fill").drop("proportion")
    return rows.join(top, "_genus", "left").withColumn(category, F.coalesce(category, "_fill")).drop("_fill", "_genus")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``; equal rows of ``df`` are told apart by nothing."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def best_per_key(df: DataFrame, key: list[str], order: Column, least: bool = False) -> DataFrame:
    """Like :func:`first_per_key`, by a partial aggregation that combines on the map side: ``order`` must be total."""
    rest = [c for c in df.columns if c not in key]
    pick = (F.min_by if least else F.max_by)(F.struct(*rest), order)
    return df.groupBy(*key).agg(pick.alias("_x")).select(*key, "_x.*")


def filter_trait_set(df: DataFrame, name: str) -> DataFrame:
    """Rows of the plot source (``s``), of the occurrence source (``g``), or of both with plots preferred on shared cells (``sg``)."""
    if name in ("s", "g"):
        return df.filter(F.col("source") == name)
    if name != "sg":
        raise ValueError(f"unknown trait set {name!r}")
    return best_per_key(df, ["x", "y"], F.struct("source", *[c for c in df.columns if c not in ("x", "y", "source")]))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union in which the newest row of a key wins."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_age")]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_age", *rest)).alias("_x")).select(*key, "_x.*")


def missing(expected: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Expected items that are not done yet."""
    return expected.join(done, key, "left_anti")


def unique_join(left: DataFrame, right: DataFrame, on: list[str], validate: str = "m:1", how: str = "inner") -> DataFrame:
    """Join that fails on duplicate keys of the sides that ``validate`` calls 1."""
    sides = validate.split(":")
    for side, df in zip(sides, (left, right)):
        if side == "1" and not df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"keys {on} are not unique on a side that must be (join is {validate})")
    return left.join(right, on, how)


def reliability(df: DataFrame, column: str, how: str = "sqrt", low: float = 0.1, high: float = 1.0) -> DataFrame:
    """Adds ``reliability``: counts transformed, then scaled to [low, high] over all rows; constant counts get ``high``."""
    x = {"sqrt": F.sqrt, "log1p": F.log1p, "none": lambda c: c.cast("double")}[how](F.col(column))
    ends = F.broadcast(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")))  # one row
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(high)).otherwise(low + (x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (high - low))
    return df.crossJoin(ends).withColumn("reliability", F.when(F.col(column).isNotNull(), scaled)).drop("_lo", "_hi")


def source_weights(df: DataFrame, source: str = "source") -> DataFrame:
    """Adds weight 1 to 's' rows and (share of 's') to 'g' rows; 1 for all if there is one source only. Sizes are those of the whole frame given."""
    n = F.broadcast(df.agg(F.count_if(F.col(source) == "s").alias("_s"), F.count(F.lit(1)).alias("_all")))  # one row
    w = F.when((F.col("_s") == 0) | (F.col("_s") == F.col("_all")) | (F.col(source) == "s"), F.lit(1.0)).otherwise(F.col("_s") / F.col("_all"))
    return df.crossJoin(n).withColumn("weight", w).drop("_s", "_all")


def holdout(df: DataFrame, of: Column, share: float, key: Column) -> DataFrame:
    """Adds is_test: exactly floor(share * n) of the rows ``of`` describes, the first in the order of the number ``key``, equal keys in the order of a hash of the row.

    Ranks come from sums over ranges of the key, so no global sort or one-task window is needed."""
    names, own = df.columns, F.coalesce(of, F.lit(False))
    ranked = running(df.select("*", key.alias("_key"), own.alias("_of")), "_key", [F.xxhash64(*names)], {"_r": F.col("_of").cast("int")})
    return ranked.select(*names, (F.col("_of") & (F.col("_r") <= F.floor(share * F.col("_r_all")))).alias("is_test"))
