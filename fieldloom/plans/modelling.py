"""Queries: scores, correlations, reports, transforms, models, applicability, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.power import yeo_johnson, yeo_johnson_inverse
from fieldloom.operators import assemble, metrics, model, stats
from fieldloom.plans.base import gridded, lat_of, obs, query, rounded
from fieldloom.sources.readers import raster_metadata, table
from fieldloom.streaming.events import windowed_stats

_OP = "op AS (SELECT l_linenumber AS fold, l_returnflag AS trait, l_extendedprice AS obs, l_quantity * p_retailprice AS pred, (l_suppkey * 91 % 17000) / 100e0 - 85 AS lat FROM lineitem JOIN part ON l_partkey = p_partkey)"
_METRICS = "1 - sum((obs - pred) * (obs - pred)) / (var_pop(obs) * count(*)) AS r2, corr(obs, pred) AS pearsonr, sqrt(avg((obs - pred) * (obs - pred))) AS rmse, sqrt(avg((obs - pred) * (obs - pred))) / (quantile_cont(obs, 0.99) - quantile_cont(obs, 0.01)) AS nrmse, avg((obs - pred) * (obs - pred)) AS mse, avg(abs(obs - pred)) AS mae, quantile_cont(abs(obs - pred), 0.5) AS medae"


def _predictions(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("trait"), F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"), lat_of(F.col("l_suppkey")).alias("lat"))


def _r(cols, digits=4):
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in cols)


@query("regression_metrics", f"WITH {_OP}, a AS (SELECT trait, {_METRICS} FROM op GROUP BY trait) SELECT trait, {_r(metrics.METRICS, 3)} FROM a")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(_predictions(spark, sf_dir), ["trait"]), 3)


_FW = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in metrics.METRICS)


@query("foldwise_metrics", f"WITH {_OP}, a AS (SELECT trait, fold, {_METRICS} FROM op GROUP BY 1, 2), b AS (SELECT trait, {_FW} FROM a GROUP BY 1) SELECT trait, {_r([f'{m}_{s}' for m in metrics.METRICS for s in ('mean', 'std')], 3)} FROM b")
def foldwise_metrics(spark, sf_dir):
    return rounded(metrics.foldwise(_predictions(spark, sf_dir), "fold", ["trait"]), 3)


@query("pearson_pairs", "WITH {obs}, m AS (SELECT \"row\", \"col\", avg(v) FILTER (source = 'F') AS a, avg(v) FILTER (source = 'O') AS b FROM obs GROUP BY 1, 2) SELECT round(corr(a, b), 6) + 0e0 AS r, count(*) AS n FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def pearson_pairs(spark, sf_dir):
    """Correlation of two maps over their shared cells."""
    m = gridded(spark, sf_dir).groupBy("row", "col", "source").agg(F.avg("v").alias("v"))
    a, b = m.filter("source = 'F'").select("row", "col", F.col("v").alias("a")), m.filter("source = 'O'").select("row", "col", F.col("v").alias("b"))
    return rounded(a.join(b, ["row", "col"]).agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n")), 6)


@query("area_weighted_r", f"WITH {_OP}, w AS (SELECT trait, obs AS x, pred AS y, cos(radians(lat)) AS w FROM op), m AS (SELECT trait, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1) SELECT trait, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 5) + 0e0 AS r FROM w JOIN m USING (trait) GROUP BY trait")
def area_weighted_r(spark, sf_dir):
    """Pearson's r weighted by the cosine of latitude."""
    df = _predictions(spark, sf_dir).withColumn("w", F.cos(F.radians("lat")))
    return rounded(df.groupBy("trait").agg(metrics.weighted_pearson(F.col("obs"), F.col("pred"), F.col("w")).alias("r")), 5)


def _coverage(spark, sf_dir, df):
    known = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_name").alias("species"), F.lit(True).alias("hit")).distinct()
    df = df.join(known, "species", "left")
    return rounded(df.groupBy("pft").agg(F.count(F.lit(1)).alias("n_before"), F.count("hit").alias("n_after"), F.countDistinct("species").alias("species_before"), F.countDistinct(F.when(F.col("hit"), F.col("species"))).alias("species_after"), (100 * F.count("hit") / F.count(F.lit(1))).alias("percent")))


@query("trait_coverage", "WITH {obs}, k AS (SELECT DISTINCT p_name AS species FROM part WHERE p_size > 40), a AS (SELECT pft, species, v, species IN (SELECT species FROM k) AS hit FROM obs) SELECT pft, count(*) AS n_before, count(*) FILTER (hit) AS n_after, count(DISTINCT species) AS species_before, count(DISTINCT species) FILTER (hit) AS species_after, round(100 * count(*) FILTER (hit) / count(*), 4) + 0e0 AS percent FROM a GROUP BY pft")
def trait_coverage(spark, sf_dir):
    """Observations and species before and after a match, in one aggregation over a flag."""
    return _coverage(spark, sf_dir, obs(spark, sf_dir))


_BS = ", ".join(f"coalesce(max({s}) FILTER (source = '{x}'), 0) + 0e0 AS {s}_{x}" for s in ("min", "max", "mean", "median") for x in ("F", "O"))


@query("biome_source_pivot", f"WITH {{obs}}, c AS (SELECT pft, source, \"row\" // 3 AS biome, count(*) AS n FROM obs GROUP BY 1, 2, 3), a AS (SELECT biome, source, min(n) AS min, max(n) AS max, round(avg(n), 4) AS mean, quantile_cont(n, 0.5) AS median FROM c GROUP BY 1, 2) SELECT biome::BIGINT AS biome, {_BS} FROM a GROUP BY biome")
def biome_source_pivot(spark, sf_dir):
    """Counts of observations per trait, source and zone, summarised over traits and pivoted by source."""
    c = gridded(spark, sf_dir).groupBy("pft", "source", F.floor(F.col("row") / 3).alias("biome")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    wide = assemble.pivot_stats(c, ["biome"], "source", ["F", "O"], {"min": F.min("n"), "max": F.max("n"), "mean": F.round(F.avg("n"), 4), "median": F.percentile("n", F.lit(0.5))})
    return wide.fillna(0.0)


def _aoa(spark, sf_dir):
    return gridded(spark, sf_dir).groupBy("row", "col", "source").agg((F.avg("v") > 45000).cast("int").alias("aoa"), F.floor(F.col("row") / 3).alias("biome"))


_AOA = 'z AS (SELECT "row", "col", source, (avg(v) > 45000)::INT AS aoa, "row" // 3 AS biome FROM obs GROUP BY 1, 2, 3)'


@query("aoa_fraction", "WITH {obs}, " + _AOA + " SELECT biome::BIGINT AS biome, round(1 - avg(aoa), 6) + 0e0 AS aoa_frac FROM z GROUP BY 1")
def aoa_fraction(spark, sf_dir):
    return rounded(metrics.inside_share(gridded(spark, sf_dir).groupBy("row", "col", "source").agg((F.avg("v") > 45000).alias("aoa")).withColumn("biome", F.floor(F.col("row") / 3)), ["biome"]), 6)


@query("aoa_global", "WITH {obs}, " + _AOA + " SELECT round(1 - count(*) FILTER (aoa = 1) / nullif(count(*) FILTER (aoa = 0), 0), 6) + 0e0 AS literal, round(1 - count(*) FILTER (aoa = 1) / count(*), 6) + 0e0 AS corrected FROM z")
def aoa_global(spark, sf_dir):
    z = gridded(spark, sf_dir).groupBy("row", "col", "source").agg((F.avg("v") > 45000).cast("int").alias("aoa"))
    return rounded(z.agg(metrics.global_fraction(F.col("aoa")).alias("literal"), metrics.global_fraction(F.col("aoa"), False).alias("corrected")), 6)


@query("aoa_majority", "WITH {obs}, " + _AOA + ' SELECT "row", "col", CASE WHEN count(aoa) = count(*) THEN (sum(aoa) >= 1)::INT END AS majority FROM z GROUP BY 1, 2')
def aoa_majority(spark, sf_dir):
    z = gridded(spark, sf_dir).groupBy("row", "col", "source").agg((F.avg("v") > 45000).cast("int").alias("aoa"))
    return metrics.majority(z, ["row", "col"], "aoa", 2)


@query("aoa_difference", "WITH {obs}, " + _AOA + ', p AS (SELECT "row", "col", max(aoa) FILTER (source = \'F\') AS f, max(aoa) FILTER (source = \'O\') AS o FROM z GROUP BY 1, 2) SELECT "row", "col", (f - o)::DOUBLE AS difference FROM p')
def aoa_difference(spark, sf_dir):
    """Three-class difference of two layers."""
    z = gridded(spark, sf_dir).groupBy("row", "col", "source").agg((F.avg("v") > 45000).cast("int").alias("aoa"))
    return metrics.difference(z.filter("source = 'F'"), z.filter("source = 'O'"), ["row", "col"], "aoa").withColumn("difference", F.col("difference").cast("double"))


@query("class_means", "WITH {obs} SELECT \"row\" // 3 AS biome, round(avg(v), 4) + 0e0 AS mean FROM obs WHERE \"row\" // 3 BETWEEN 1 AND 4 GROUP BY 1")
def class_means(spark, sf_dir):
    g = gridded(spark, sf_dir).withColumn("biome", F.expr("row div 3"))
    return rounded(g.filter("biome BETWEEN 1 AND 4").groupBy("biome").agg(F.avg("v").alias("mean")))


@query("perf_tiers", "WITH {obs}, a AS (SELECT species, avg(v) AS m FROM obs GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY m DESC, species) AS r, count(*) OVER () AS n FROM a) SELECT species, CASE WHEN r <= floor(n * 0.3) THEN 'high' WHEN r <= floor(n * 0.7) THEN 'medium' ELSE 'low' END AS tier FROM b")
def perf_tiers(spark, sf_dir):
    return metrics.tiers(obs(spark, sf_dir).groupBy("species").agg(F.avg("v").alias("m")), "m", "species").select("species", "tier")


@query("top_bottom", "WITH {obs}, a AS (SELECT pft, species, avg(v) AS m FROM obs GROUP BY 1, 2) SELECT pft, arg_max(species, m) AS best, arg_min(species, m) AS worst FROM a GROUP BY pft")
def top_bottom(spark, sf_dir):
    a = obs(spark, sf_dir).groupBy("pft", "species").agg(F.avg("v").alias("m"))
    return a.groupBy("pft").agg(F.max_by("species", "m").alias("best"), F.min_by("species", "m").alias("worst"))


@query("top_counts", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def top_counts(spark, sf_dir):
    """A top-k report."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("stack_importance", "SELECT p_partkey, 'size' AS feature, p_size::DOUBLE AS importance FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def stack_importance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return assemble.unpivot(p, ["p_partkey"], ["size", "price"], "feature", "importance")


@query("pivot_importance", "WITH {obs} SELECT pft, round(avg(v) FILTER (source = 'F'), 4) + 0e0 AS mean_F, round(avg(v) FILTER (source = 'O'), 4) + 0e0 AS mean_O FROM obs GROUP BY pft")
def pivot_importance(spark, sf_dir):
    return rounded(assemble.pivot_stats(obs(spark, sf_dir), ["pft"], "source", ["F", "O"], {"mean": F.avg("v")}))


@query("importance_by_fold", "SELECT l_returnflag AS feature, round(avg(m), 4) + 0e0 AS mean, round(stddev_samp(m), 4) + 0e0 AS std, count(*) AS n, round(CASE count(*) WHEN 7 THEN 2.447e0 END * stddev_samp(m) / sqrt(count(*)), 4) + 0e0 AS half FROM (SELECT l_returnflag, l_linenumber, avg(l_tax * 1000) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def importance_by_fold(spark, sf_dir):
    """Mean, std and interval over folds."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg(F.col("l_tax") * 1000).alias("m"))
    out = per.groupBy(F.col("l_returnflag").alias("feature")).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.count(F.lit(1)).alias("n"))
    return rounded(out.withColumn("half", metrics.error_bar(F.col("std"), F.col("n"))))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query("raster_metadata", "WITH {obs} SELECT pft, count(v) AS n, min(v) AS min, max(v) AS max, count(*) - count(v) AS missing FROM obs GROUP BY pft")
def raster_metadata_(spark, sf_dir):
    return raster_metadata(obs(spark, sf_dir), ["pft"], "v")


# --- transforms -------------------------------------------------------------------------------------


@query("log1p_traits", "SELECT p_partkey, round(ln(1 + p_size), 8) + 0e0 AS size_ln, round(ln(1 + p_retailprice), 8) + 0e0 AS price_ln FROM part")
def log1p_traits(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return rounded(model.log_transform(p, ["size", "price"]), 8)


@query("zscore", "SELECT p_partkey, round((p_retailprice - m) / s, 6) + 0e0 AS price, round((p_size - sm) / ss, 6) + 0e0 AS size FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(p_size) AS sm, stddev_pop(p_size) AS ss FROM part)")
def zscore(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rounded(model.standardise(p, ["size", "price"]), 6)


@query("min_max", "SELECT p_partkey, round((p_size - lo) / (hi - lo), 8) + 0e0 AS size FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def min_max(spark, sf_dir):
    return rounded(model.min_max(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size")), ["size"]), 8)


_YJ = "CASE WHEN x >= 0 THEN (pow(x + 1, 0.4e0) - 1) / 0.4e0 ELSE -(pow(1 - x, 1.6e0) - 1) / 1.6e0 END"


@query("yeojohnson_apply", f"SELECT p_partkey, round({_YJ}, 6) + 0e0 AS y FROM (SELECT p_partkey, p_size - 25e0 AS x FROM part)")
def yeojohnson_apply(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", yeo_johnson(F.col("p_size") - 25.0, F.lit(0.4)).alias("y")), 6)


@query("yeojohnson_inverse", "SELECT p_partkey, round(p_size - 25e0, 6) + 0e0 AS x FROM part")
def yeojohnson_inverse(spark, sf_dir):
    """There and back again."""
    return rounded(table(spark, sf_dir, "part").select("p_partkey", yeo_johnson_inverse(yeo_johnson(F.col("p_size") - 25.0, F.lit(0.4)), F.lit(0.4)).alias("x")), 6)


@query("yeojohnson_fit")
def yeojohnson_fit(spark, sf_dir):
    return model.fit_power(obs(spark, sf_dir).select(F.col("pft").alias("trait"), F.col("v").alias("value")), gate=0.15)


@query("pca_embed")
def pca_embed(spark, sf_dir):
    """Three principal components of the embeddings."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean, rows, _ = model.pca(df, "x", 3)
    return rounded(model.project(df, "x", mean, rows).drop("x"), 6)


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    """The five largest loadings of three components, and the error of rebuilding from them."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean, rows, _ = model.pca(df, "x", 3)
    top = spark.createDataFrame(model.loadings(rows, [f"e{i}" for i in range(len(mean))], 5), "component int, name string, loading double")
    return top.crossJoin(F.broadcast(model.reconstruct(df, "x", mean, rows)))  # one row


@query("impute_median", "WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price FROM part), m AS (SELECT quantile_disc(price, 0.5) AS m FROM h) SELECT count(*) AS n, count(*) FILTER (abs(coalesce(price, m) - m) < 1e9) AS filled FROM h, m")
def impute_median(spark, sf_dir):
    """Missing prices by the median: all rows are filled afterwards."""
    h = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"))
    return model.impute(h, ["price"]).agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("filled"))


def _type_sql(c: str, kind: str) -> str:
    steps = " ".join(f"WHEN -{2**b} < min({c}) AND max({c}) < {2**b - 1} THEN '{t}'" for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31)))
    whole = f"WHEN bool_or({c} <> round_even({c}, 0)) THEN '{kind}' " if kind == "double" else ""
    return f"SELECT '{c}' AS name, CASE {whole}{steps} ELSE 'bigint' END AS type FROM part"


@query("column_types", " UNION ALL ".join([_type_sql(c, k) for c, k in (("p_partkey", "bigint"), ("p_size", "int"), ("p_retailprice", "double"))] + [f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) < 0.5 * count(*) THEN 'category' ELSE 'string' END FROM part" for c in ("p_name", "p_brand", "p_type")]))
def column_types(spark, sf_dir):
    """The smallest type for each column of part."""
    types = stats.optimal_types(table(spark, sf_dir, "part"), 0.5)
    return spark.createDataFrame(sorted(types.items()), "name string, type string")


# --- models and applicability -----------------------------------------------------------------------


def _train(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 97).cast("double").alias("noise"), F.col("p_retailprice").alias("price"), (F.col("p_size") * 3.0 + F.col("p_retailprice") / 100).alias("obs"), (F.col("p_partkey") % 5).cast("int").alias("fold"), F.lit(1.0).alias("weight"))


@query("gbt_cv_metrics")
def gbt_cv_metrics(spark, sf_dir):
    """Scores of every fold's model on the rows that it has not seen, and their mean and std."""
    return model.cross_validate(_train(spark, sf_dir), ["size", "noise", "price"], "obs", "fold", "weight")


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Of every fold's model on that fold's rows."""
    return model.fold_importance(_train(spark, sf_dir), ["size", "noise", "price"], {"size": ["size"], "noise": ["noise"], "both": ["size", "price"]}, "obs", "fold", "p_partkey", 2)


@query("cov_across_folds", "WITH {obs}, f AS (SELECT \"row\", \"col\", plot % 5 AS fold, avg(v) - 30000 AS p FROM obs GROUP BY 1, 2, 3), c AS (SELECT abs(min(p)) AS c FROM f) SELECT \"row\", \"col\", round(stddev_samp(p + c) / avg(p + c), 6) + 0e0 AS cov FROM f, c GROUP BY 1, 2")
def cov_across_folds(spark, sf_dir):
    f = gridded(spark, sf_dir).groupBy("row", "col", (F.col("plot") % 5).alias("fold")).agg((F.avg("v") - 30000).alias("p"))
    return rounded(model.coefficient_of_variation(f, ["row", "col"], "p"), 6)


_E = "e AS (SELECT vec_id, label % 5 AS fold, embedding::DOUBLE[] AS x FROM embeddings)"
_DBAR = "m AS (SELECT avg(list_distance(a.x, b.x)) AS mean_distance FROM e a, e b)"


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5).cast("int").alias("fold"), F.col("embedding").cast("array<double>").alias("x"))


@query("di_mean_distance", f"WITH {_E}, {_DBAR} SELECT round(mean_distance, 5) + 0e0 AS mean_distance FROM m")
def di_mean_distance(spark, sf_dir):
    return rounded(model.mean_distance(_emb(spark, sf_dir), "vec_id", "x"), 5)


_NN = "n AS (SELECT a.vec_id, a.fold, b.fold AS other, min(list_distance(a.x, b.x)) AS dist FROM e a JOIN e b ON a.fold <> b.fold GROUP BY 1, 2, 3)"


@query("di_nearest", f"WITH {_E}, {_NN} SELECT vec_id, fold, other, round(dist, 5) + 0e0 AS dist FROM n")
def di_nearest(spark, sf_dir):
    """Distance of each training row to the nearest one of every other fold."""
    e = _emb(spark, sf_dir)
    return rounded(model.nearest_distance(e, e, "vec_id", "x", "fold"), 5)


_T = "t AS (SELECT (quantile_cont(dist, 0.75) + 1.5e0 * (quantile_cont(dist, 0.75) - quantile_cont(dist, 0.25))) / any_value(mean_distance) AS threshold FROM n, m)"


@query("di_threshold", f"WITH {_E}, {_DBAR}, {_NN}, {_T} SELECT round(threshold, 4) + 0e0 AS threshold FROM t")
def di_threshold(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return rounded(model.di_threshold(model.nearest_distance(e, e, "vec_id", "x", "fold"), model.mean_distance(e, "vec_id", "x")), 4)


@query("aoa_flag", f"WITH {_E}, {_DBAR}, {_NN}, {_T}, p AS (SELECT vec_id, list_transform(x, lambda v: v * 1.05e0 + 0.01e0) AS x FROM e), d AS (SELECT p.vec_id, min(list_distance(p.x, e.x)) AS dist FROM p, e GROUP BY 1) SELECT vec_id, round(dist / mean_distance, 4) + 0e0 AS di, dist / mean_distance > threshold AS aoa FROM d, m, t")
def aoa_flag(spark, sf_dir):
    """Dissimilarity and applicability of moved vectors; true is outside."""
    e = _emb(spark, sf_dir)
    moved = e.select("vec_id", F.transform("x", lambda v: v * 1.05 + 0.01).alias("x"))
    mean = model.mean_distance(e, "vec_id", "x")
    out = model.applicability(model.nearest_distance(moved, e, "vec_id", "x"), mean, model.di_threshold(model.nearest_distance(e, e, "vec_id", "x", "fold"), mean))
    return rounded(out.select("vec_id", "di", "aoa"), 4)


@query("feature_scaling", "WITH f AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM embeddings), s AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM f GROUP BY 1) SELECT vec_id, round(sum(abs((v - m) / s)), 3) + 0e0 AS total FROM f JOIN s USING (i) GROUP BY 1")
def feature_scaling(spark, sf_dir):
    z = model.scaled_features(_emb(spark, sf_dir).select("vec_id", "x"), "x")
    return rounded(z.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("total")), 3)


@query("final_product", "WITH {obs}, p AS (SELECT \"row\", \"col\", avg(v) AS pred, stddev_samp(v) / avg(v) AS cov, (count(*) < 50)::INT AS aoa FROM obs GROUP BY 1, 2) SELECT \"row\", \"col\", round(pred, 4) + 0e0 AS pred, CASE WHEN \"row\" < 10 THEN round(cov, 6) + 0e0 END AS cov, aoa FROM p")
def final_product(spark, sf_dir):
    """Three bands joined cell by cell; cells without a band keep null there."""
    from fieldloom.operators.raster import final_product as build

    g = gridded(spark, sf_dir).groupBy("row", "col").agg(F.avg("v").alias("pred"), (F.stddev_samp("v") / F.avg("v")).alias("cov"), (F.count(F.lit(1)) < 50).cast("int").alias("aoa"))
    return rounded(rounded(build(g.select("row", "col", "pred"), g.filter("row < 10").select("row", "col", "cov"), g.select("row", "col", "aoa")), 4, "pred"), 6, "cov")


@query("events_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 4) + 0e0 AS mean, round(sum(value), 2) + 0e0 AS total FROM events GROUP BY 1, 2")
def events_windows(spark, sf_dir):
    """The batch form of the streaming aggregation (an extension)."""
    return rounded(rounded(windowed_stats(table(spark, sf_dir, "events")), 4, "mean"), 2, "total")
