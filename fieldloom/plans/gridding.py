"""Queries: gridded and plot statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators import assemble, clean, diversity, stats
from fieldloom.plans.base import gridded, obs, query, rounded
from fieldloom.sources.readers import table

TYPES = ["ECONOMY", "STANDARD"]


def _weighted_sql(by: str, tail: str = "") -> str:
    qs = ", ".join(f"min(v) FILTER (cw >= {q} * tot) AS {n}" for n, q in stats.WEIGHTED.items())
    rounds = ", ".join(f"round({n}, 4) + 0e0 AS {n}" for n in ("mean", "std", *stats.WEIGHTED))
    return f"""
WITH {{obs}},
c AS (SELECT {by}, v, w, sum(w) OVER (PARTITION BY {by} ORDER BY v) AS cw, sum(w) OVER (PARTITION BY {by}) AS tot, sum(w * v) OVER (PARTITION BY {by}) / sum(w) OVER (PARTITION BY {by}) AS mu FROM obs),
a AS (SELECT {by}, any_value(mu) AS mean, sqrt(sum(w * (v - mu) * (v - mu)) / sum(w)) AS std, {qs}, count(*) AS count, sum(w) AS count_weighted FROM c GROUP BY {by})
SELECT {by}, {rounds}, count, count_weighted FROM a {tail}"""


@query("grid_weighted_stats", _weighted_sql('"row", "col"'))
def grid_weighted_stats(spark, sf_dir):
    """The flagship: weighted statistics of a trait by grid cell."""
    return rounded(stats.weighted_stats(gridded(spark, sf_dir), ["row", "col"], "v", "w"), 4, "mean", "std", *stats.WEIGHTED)


@query("trait_maps_all_types", _weighted_sql('pft, "row", "col"'))
def trait_maps_all_types(spark, sf_dir):
    """All traits' maps in one job: the long form with the trait as one more key."""
    return rounded(stats.weighted_stats(gridded(spark, sf_dir), ["pft", "row", "col"], "v", "w"), 4, "mean", "std", *stats.WEIGHTED)


@query("grid_min_count", _weighted_sql('"row", "col"', "WHERE count >= 100 AND count_weighted >= 3000"))
def grid_min_count(spark, sf_dir):
    return rounded(stats.weighted_stats(gridded(spark, sf_dir), ["row", "col"], "v", "w", min_count=100, min_weight=3000), 4, "mean", "std", *stats.WEIGHTED)


_NEAREST = {"median": 0.5, "q02": 0.02, "q05": 0.05, "q95": 0.95, "q98": 0.98}


@query(
    "grid_stats_nearest",
    """
WITH {obs},
a AS (SELECT "row", "col", avg(v) AS mean, stddev_samp(v) AS std, count(v) AS count, count(DISTINCT species_key) AS species_count, list_sort(list(v)) AS l FROM obs GROUP BY 1, 2)
SELECT "row", "col", round(mean, 4) + 0e0 AS mean, round(std, 4) + 0e0 AS std, count, species_count,"""
    + ", ".join(f" l[round_even({q} * (count - 1), 0)::INT + 1] AS {n}" for n, q in _NEAREST.items())
    + ", round(l[round_even(0.98 * (count - 1), 0)::INT + 1] - l[round_even(0.02 * (count - 1), 0)::INT + 1], 4) + 0e0 AS range FROM a",
)
def grid_stats_nearest(spark, sf_dir):
    """Unweighted statistics with nearest-rank quantiles, range and number of species."""
    funcs = {"mean": ("v", "mean"), "std": ("v", "std"), "count": ("v", "count"), "species_count": ("species_key", "species_count")}
    return rounded(stats.grouped_stats(gridded(spark, sf_dir), ["row", "col"], "v", funcs, _NEAREST), 4, "mean", "std", "range")


@query(
    "grid_latlon_bins",
    """WITH {obs} SELECT floor((lat + 90) / 5e0) * 5 - 90 + 2.5e0 AS y, floor((lon + 180) / 5e0) * 5 - 180 + 2.5e0 AS x, count(*) AS n, round(avg(v), 4) + 0e0 AS mean FROM obs GROUP BY 1, 2""",
)
def grid_latlon_bins(spark, sf_dir):
    binned = obs(spark, sf_dir).withColumn("y", geo.degree_bin(F.col("lat"), 90, 5.0)).withColumn("x", geo.degree_bin(F.col("lon"), 180, 5.0))
    return rounded(binned.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), 4, "mean")


@query("cwm_plot_stats", "SELECT * EXCLUDE (count_weighted) FROM (" + _weighted_sql("plot") + ")")
def cwm_plot_stats(spark, sf_dir):
    """Community-weighted statistics of each plot."""
    return rounded(stats.community_stats(obs(spark, sf_dir), "plot", "v", "w"), 4, "mean", "std", *stats.WEIGHTED)


def _carried_sql() -> str:
    qs = ", ".join(f"min(v) FILTER (cw >= {q} * tot) AS {n}" for n, q in stats.WEIGHTED.items())
    means = ", ".join(f"round(sum(pw * {n}) / sum(pw) FILTER ({n} IS NOT NULL), 4) + 0e0 AS {n}" for n in ("mean", "std", *stats.WEIGHTED))
    return f"""
WITH {{obs}},
c AS (SELECT plot, v, w, sum(w) OVER (PARTITION BY plot ORDER BY v) AS cw, sum(w) OVER (PARTITION BY plot) AS tot, sum(w * v) OVER (PARTITION BY plot) / sum(w) OVER (PARTITION BY plot) AS mu FROM obs),
a AS (SELECT plot, any_value(mu) AS mean, sqrt(sum(w * (v - mu) * (v - mu)) / sum(w)) AS std, {qs} FROM c GROUP BY plot),
p AS (SELECT plot, sum(w) AS pw, min(lon) AS lon, min(lat) AS lat FROM obs GROUP BY plot)
SELECT trunc((90 - lat) / 10e0)::INT AS "row", trunc((lon + 180) / 10e0)::INT AS "col", {means}, count(*) AS count FROM a JOIN p USING (plot) GROUP BY 1, 2"""


@query("plot_stats_to_grid", _carried_sql())
def plot_stats_to_grid(spark, sf_dir):
    """All nine statistics of plots carried to grid cells, each as a mean weighted by plot."""
    from fieldloom.operators.raster import with_cells

    o = obs(spark, sf_dir)
    places = o.groupBy("plot").agg(F.sum("w").alias("pw"), F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    names = ("mean", "std", *stats.WEIGHTED)
    plots = with_cells(stats.community_stats(o, "plot", "v", "w").drop("count").join(places, "plot"), "lon", "lat", 10.0)
    cells = plots.groupBy("row", "col").agg(*[(F.sum(F.col("pw") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("pw")))).alias(c) for c in names], F.count(F.lit(1)).alias("count"))
    return rounded(cells, 4, *names)


@query("species_mean", "WITH {obs} SELECT species, round(avg(v), 4) + 0e0 AS mean, count(*) AS n FROM obs GROUP BY species")
def species_mean(spark, sf_dir):
    return rounded(obs(spark, sf_dir).groupBy("species").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")))


@query("species_median", "WITH {obs} SELECT species, round(quantile_cont(v, 0.5), 4) + 0e0 AS median, round(quantile_cont(price, 0.5), 4) + 0e0 AS price FROM obs GROUP BY species")
def species_median(spark, sf_dir):
    both = F.explode(F.array(F.struct(F.lit("median").alias("what"), F.col("v").alias("x")), F.struct(F.lit("price").alias("what"), F.col("price").alias("x"))))
    per = stats.linear_quantiles(obs(spark, sf_dir).select("species", both.alias("s")).select("species", "s.*"), ["species", "what"], "x", {"m": 0.5})
    return rounded(assemble.outer_wide(per, ["species"], "what", "m", ["median", "price"]))


_PROFILE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "column_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) + 0e0 AS mean, round(stddev_samp({c}), 4) + 0e0 AS std, round(quantile_cont({c}, 0.5), 4) + 0e0 AS median, min({c}) AS min, max({c}) AS max, count(*) - count({c}) AS missing FROM lineitem" for c in _PROFILE),
)
def column_profile(spark, sf_dir):
    return rounded(stats.column_profile(table(spark, sf_dir, "lineitem"), list(_PROFILE)), 4, "mean", "std", "median")


@query("value_shares", "SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0e0 AS share FROM part GROUP BY p_type")
def value_shares(spark, sf_dir):
    return rounded(stats.value_shares(table(spark, sf_dir, "part"), "p_type"), 6)


@query("group_cap", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r <= 20")
def group_cap(spark, sf_dir):
    """At most 20 rows a group, in a natural order so that SQL can follow."""
    df = table(spark, sf_dir, "lineitem")
    return stats.cap_per_group(df, ["l_suppkey"], 20, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_P = "p AS (SELECT plot, species_key, sum(w) AS a, min(size) AS t1, min(price) AS t2 FROM obs GROUP BY 1, 2), s AS (SELECT *, a / sum(a) OVER (PARTITION BY plot) AS p FROM p)"


def _plots(spark, sf_dir):
    return diversity.proportions(obs(spark, sf_dir), "plot", "species_key", "w", ["size", "price"])


@query("simpson", "WITH {obs}, " + _P + " SELECT plot, round(1 - sum(p * p), 6) + 0e0 AS simpson FROM s GROUP BY plot")
def simpson(spark, sf_dir):
    return rounded(diversity.simpson(_plots(spark, sf_dir), "plot"), 6)


_RAO = "r AS (SELECT x.plot, sum(x.p * y.p * sqrt((x.t1 - y.t1) * (x.t1 - y.t1) + (x.t2 - y.t2) * (x.t2 - y.t2))) AS rao FROM s x JOIN s y ON x.plot = y.plot AND x.species_key < y.species_key GROUP BY x.plot)"


@query("rao_q", "WITH {obs}, " + _P + ", " + _RAO + " SELECT plot, round(rao, 5) + 0e0 AS rao FROM r")
def rao_q(spark, sf_dir):
    return rounded(diversity.rao(_plots(spark, sf_dir), "plot", "species_key", ["size", "price"]), 5)


@query(
    "mpd_redundancy",
    "WITH {obs}, " + _P + ", " + _RAO + ", m AS (SELECT plot, 1 - sum(p * p) AS simpson FROM s GROUP BY plot) SELECT plot, round(simpson, 5) + 0e0 AS simpson, round(coalesce(rao, 0), 5) + 0e0 AS rao, round(CASE WHEN simpson > 1e-12 THEN coalesce(rao, 0) / simpson END, 5) + 0e0 AS mpd, round(1 - CASE WHEN simpson > 1e-12 THEN coalesce(rao, 0) / simpson END, 5) + 0e0 AS f_red FROM m LEFT JOIN r USING (plot)",
)
def mpd_redundancy(spark, sf_dir):
    return rounded(diversity.dissimilarity(_plots(spark, sf_dir), "plot", "species_key", ["size", "price"]), 5)


@query(
    "fd_gated",
    "WITH {obs}, k AS (SELECT plot FROM obs GROUP BY plot HAVING count(*) BETWEEN 3 AND 6 AND sum(w) >= 80), " + _P.replace("FROM obs", "FROM obs SEMI JOIN k USING (plot)") + ", " + _RAO + " SELECT plot, round(1 - sum(p * p), 5) + 0e0 AS simpson, round(any_value(coalesce(rao, 0)), 5) + 0e0 AS rao FROM s LEFT JOIN r USING (plot) GROUP BY plot",
)
def fd_gated(spark, sf_dir):
    """Diversity of plots with enough rows and abundance."""
    return rounded(diversity.gated_diversity(obs(spark, sf_dir), "plot", "species_key", "w", ["size", "price"], 80, 3, 6).select("plot", "simpson", "rao"), 5)


@query("functional_diversity")
def functional_diversity(spark, sf_dir):
    """Richness by convex hull and evenness by spanning tree, of every plot."""
    return diversity.functional_diversity(obs(spark, sf_dir), "plot", "species_key", "w", ["size", "price"])


@query(
    "plot_abundance_gate",
    "WITH {obs}, k AS (SELECT plot FROM obs GROUP BY plot HAVING sum(w) >= 100) SELECT plot, count(*) AS n, sum(w) AS w FROM obs SEMI JOIN k USING (plot) GROUP BY plot",
)
def plot_abundance_gate(spark, sf_dir):
    return clean.gate_by_sum(obs(spark, sf_dir), "plot", "w", 100).groupBy("plot").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
