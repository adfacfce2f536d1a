"""Grouped statistics: plain, weighted and community-weighted, with exact quantiles that survive hot groups.

Quantiles are order statistics by cumulative mass. Equal values of a group are summed first, on the
map side; a coarse grid of cut points over all values then splits every group into buckets of
bounded share, whose sums tell in which bucket a quantile lies; only inside those buckets are values
ranked. So no task holds a whole group, however large, and no row is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = 63


def _tree(c: Column, cuts: list[float], low: int, high: int) -> Column:
    """Number of cuts below ``c``, by a binary tree of comparisons."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(c > cuts[mid], _tree(c, cuts, mid + 1, high)).otherwise(_tree(c, cuts, low, mid))


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys in which null equals null; ``b`` may descend from ``a``. Keys come from ``a``."""
    own = [f"_j{i}" for i in range(len(keys))]
    on = F.lit(True)
    for k, j in zip(keys, own):
        on = on & F.col(k).eqNullSafe(F.col(j))
    right = b.select(*[F.col(k).alias(j) for k, j in zip(keys, own)], *[c for c in b.columns if c not in keys])
    return a.join(right, on, how).drop(*own)


def order_statistics(df: DataFrame, by: list[str], value: str, mass: Column, targets: Mapping[str, Callable[[Column], Column]], cuts_from: DataFrame | None = None) -> DataFrame:
    """``by`` and, for each name, the least value whose cumulative mass reaches ``target(total mass)``; the greatest value if rounding keeps it out of reach.

    Cut points come from ``cuts_from`` or ``df`` itself; they decide how evenly work is spread, never a result. Null values have no mass."""
    by_value = df.groupBy(*by, F.col(value).alias("_v")).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), mass)), F.lit(0)).alias("_m"))
    cuts = (df if cuts_from is None else cuts_from).approxQuantile(value, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 0.005)
    cuts = sorted(set(cuts))
    cells = by_value.withColumn("_b", _tree(F.col("_v"), cuts, 0, len(cuts)))
    sums = cells.groupBy(*by, "_b").agg(F.sum("_m").alias("_s"), F.max("_v").alias("_top"))
    group = Window.partitionBy(*by)  # at most CUTS + 1 rows
    ranked = sums.withColumn("_upto", F.sum("_s").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_s").over(group)).withColumn("_max", F.max("_top").over(group))
    wanted = ranked.select(*by, "_b", "_s", "_upto", "_max", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), t(F.col("_all")).cast("double").alias("t")) for n, t in targets.items()])).alias("_x"))
    hit = wanted.filter((F.col("_x.t") <= F.col("_upto")) & ((F.col("_x.t") > F.col("_upto") - F.col("_s")) | ((F.col("_upto") == F.col("_s")) & (F.col("_x.t") <= 0))))
    last = ranked.select(*by, "_max").distinct()
    inside = hit.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_b").alias("_hb"), (F.col("_upto") - F.col("_s")).alias("_before"), F.col("_x.n").alias("_n"), F.col("_x.t").alias("_t"))
    on = F.col("_b") == F.col("_hb")
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    marks = inside.groupBy(*[f"_k{i}" for i in range(len(by))], "_hb", "_before").agg(F.collect_list(F.struct("_n", "_t")).alias("_ts"))  # as many as targets
    run = F.col("_before") + F.sum("_m").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = cells.join(marks, on).withColumn("_cum", run).select(*by, "_v", "_cum", F.explode("_ts").alias("_x"))
    found = rows.groupBy(*by).agg(*[F.min(F.when((F.col("_x._n") == n) & (F.col("_cum") >= F.col("_x._t")), F.col("_v"))).alias(n) for n in targets])
    return join_keys(last, found, by).select(*by, *[F.coalesce(n, "_max").alias(n) for n in targets])


def linear_quantiles(df: DataFrame, by: list[str], value: str, quantiles: Mapping[str, float], times: Column | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks; ``by`` may be empty. Groups without a value have nulls. A row counts ``times``, once by default."""
    times = F.lit(1) if times is None else times
    keys = by or ["_one"]
    df = df if by else df.withColumn("_one", F.lit(1))
    targets = {}
    for i, q in enumerate(quantiles.values()):
        targets[f"_lo{i}"] = lambda total, q=q: F.floor(q * (total - 1)) + 1
        targets[f"_hi{i}"] = lambda total, q=q: F.ceil(q * (total - 1)) + 1
    ranks = order_statistics(df.filter(F.col(value).isNotNull()), keys, value, times, targets)
    both = join_keys(df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), times)), F.lit(0)).alias("_n")), ranks, keys)
    at = lambda i, q: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1)))
    return both.select(*by, *[at(i, q).alias(n) for i, (n, q) in enumerate(quantiles.items())])


def running(df: DataFrame, first: str, order: list[Column], sums: Mapping[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over all rows up to each one, and ``{name}_all`` over all rows.

    Rows are in the order of the number ``first``, then of ``order``. Ranges between cut points of ``first``, CUTS + 1 of them,
    are summed before rows are, so that no task orders all rows."""
    cuts = sorted(set(df.approxQuantile(first, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 0.005)))
    cells = df.withColumn("_b", F.when(F.col(first).isNull(), -1).otherwise(_tree(F.col(first), cuts, 0, len(cuts))))
    per = cells.groupBy("_b").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    rows = F.array_sort(F.collect_list(F.struct("_b", *[f"_s_{n}" for n in sums])))  # a row a range
    total = lambda n, upto=None: F.aggregate(F.filter("_r", lambda x: F.lit(True) if upto is None else x["_b"] < upto), F.lit(0.0), lambda a, x: a + F.coalesce(x[f"_s_{n}"], F.lit(0)).cast("double"))
    table = per.agg(rows.alias("_r")).select("_r", F.explode(F.transform("_r", lambda x: x["_b"])).alias("_b")).select("_b", *[total(n, F.col("_b")).alias(f"_p_{n}") for n in sums], *[total(n).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy("_b").orderBy(F.col(first), *order).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.join(F.broadcast(table), "_b")
    return out.select(*df.columns, *[(F.col(f"_p_{n}") + F.sum(v).over(inside)).alias(n) for n, v in sums.items()], *[f"{n}_all" for n in sums])


def nearest_quantiles(df: DataFrame, by: list[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Nearest-rank quantiles: the value at index rint(q * (n - 1)), half to even."""
    return order_statistics(df, by, value, F.lit(1), {n: (lambda total, q=q: F.rint(q * (total - 1)) + 1) for n, q in quantiles.items()})


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, quantiles: Mapping[str, float], cuts_from: DataFrame | None = None) -> DataFrame:
    """The first value, in order, whose cumulative weight reaches q times the total."""
    return order_statistics(df, by, value, F.col(weight), {n: (lambda total, q=q: q * total) for n, q in quantiles.items()}, cuts_from)


WEIGHTED = {"median": 0.5, "q02": 0.02, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95, "q98": 0.98}


def weighted_stats(df: DataFrame, by: list[str], value: str, weight: str, quantiles: Mapping[str, float] = WEIGHTED, min_count: int = 0, min_weight: float | None = None) -> DataFrame:
    """mean, population std, quantiles, count (of all rows of the group) and count_weighted; a null value makes the mean null."""
    sums = df.groupBy(*by).agg(
        F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("count"), F.sum(weight).alias("count_weighted"))
    # the one wide shuffle: spread and quantiles both read it
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    sums = sums.filter(F.col("count") >= min_count)
    if min_weight is not None:
        sums = sums.filter(F.col("count_weighted") >= min_weight)
    spread = join_keys(per, sums.select(*by, "mean"), by, "inner").groupBy(*by).agg(F.sqrt(F.sum(F.col("_w") * F.pow(F.col(value) - F.col("mean"), 2)) / F.sum("_w")).alias("std"))
    ranks = weighted_quantiles(per, by, value, "_w", quantiles, df)
    return join_keys(join_keys(sums, spread, by), ranks, by).select(*by, "mean", "std", *quantiles, "count", "count_weighted")


PLAIN: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
    "species_count": F.countDistinct,
}


def grouped_stats(df: DataFrame, by: list[str], value: str, funcs: Mapping[str, tuple[str, Callable[[Column], Column] | str]], quantiles: Mapping[str, float] | None = None, n_min: int = 0) -> DataFrame:
    """One aggregation of named functions (output name -> (column, registered name or function)), plus nearest quantiles and ``range`` if q98 and q02 are among them."""
    aggs = []
    for out, (column, f) in funcs.items():
        if isinstance(f, str) and f not in PLAIN:
            raise ValueError(f"unknown statistic {f!r}; known: {sorted(PLAIN)}")
        aggs.append((PLAIN[f] if isinstance(f, str) else f)(F.col(column)).alias(out))
    out = df.groupBy(*by).agg(*aggs, F.count(value).alias("_n")).filter(F.col("_n") >= n_min).drop("_n")
    if not quantiles:
        return out
    ranks = nearest_quantiles(df, by, value, quantiles)
    joined = join_keys(out, ranks, by)
    return joined.withColumn("range", F.col("q98") - F.col("q02")) if {"q98", "q02"} <= set(quantiles) else joined


def cap_per_group(df: DataFrame, by: list[str], n: int, order: list[Column], salts: int = 64) -> DataFrame:
    """At most ``n`` rows of each group, the first in ``order``. Two levels: the first n of each of ``salts`` parts of a group, then the first n of those."""
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    first = df.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).filter(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r", "_part")


def seeded(*columns: Column | str, seed: int = 42) -> Column:
    """A deterministic shuffle order, the same however the data is partitioned."""
    return F.xxhash64(*columns, F.lit(seed))


def shuffled(*columns: Column | str, seed: int = 42) -> Column:
    """The same as a number below 2**60 that any SQL engine can follow: the head of an MD5 over the values and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns], F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def community_stats(df: DataFrame, plot: str, trait: str, abundance: str, quantiles: Mapping[str, float] = WEIGHTED) -> DataFrame:
    """Community-weighted statistics of each plot, weights renormalised over its rows with a trait value."""
    return weighted_stats(df.filter(F.col(trait).isNotNull()), [plot], trait, abundance, quantiles).drop("count_weighted")


def dominant_category(df: DataFrame, key: str, category: str, threshold: float = 0.0) -> DataFrame:
    """(key, category, proportion): the most frequent category, the first by name on ties, where its share reaches ``threshold``."""
    counts = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy(key).agg(F.sum("_n").alias("_all"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(category).alias("c"))).alias("_top"))
    return per.select(key, F.col("_top.c").alias(category), (-F.col("_top.n") / F.col("_all")).alias("proportion")).filter(F.col("proportion") >= threshold)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, median, min, max, missing) over the unpivoted table, with map-side sums and exact medians."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    median = linear_quantiles(long, ["column"], "value", {"median": 0.5})
    plain = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum(F.col("value").isNull().cast("long")).alias("missing"))
    return plain.join(median, "column").select("column", "count", "mean", "std", "median", "min", "max", "missing")


def value_shares(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share): counts of values and their share of all."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(key, "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def optimal_types(df: DataFrame, category_share: float | None = None) -> dict[str, str]:
    """Smallest type for each column from one aggregation: integral floats become integers, integers the smallest type that strictly holds them."""
    numeric = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    aggs = []
    for c, kind in numeric:
        aggs += [F.min(c).alias(f"{c}\0lo"), F.max(c).alias(f"{c}\0hi"), F.min((F.col(c) == F.rint(F.col(c).cast("double"))).cast("int")).alias(f"{c}\0whole")]
    aggs += [F.approx_count_distinct(c).alias(f"{c}\0n") for c in text] + [F.count(F.lit(1)).alias("\0all")]
    row = df.agg(*aggs).first().asDict()
    out = {}
    for c, kind in numeric:
        lo, hi = row[f"{c}\0lo"], row[f"{c}\0hi"]
        if lo is None or lo != lo or (kind in ("float", "double") and not row[f"{c}\0whole"]):
            out[c] = kind
            continue
        out[c] = next((k for k, b in (("tinyint", 7), ("smallint", 15), ("int", 31)) if -(2**b) < lo and hi < 2**b - 1), "bigint")
    for c in text:
        out[c] = "category" if category_share and row[f"{c}\0n"] < category_share * row["\0all"] else "string"
    return out
