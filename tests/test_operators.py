"""Known answers and properties of the operators."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geo, names
from fieldloom.functions.power import fit_lambda, pack, unpack, yeo_johnson, yeo_johnson_inverse
from fieldloom.operators import assemble, clean, diversity, metrics, model, raster, stats, variogram
from fieldloom.sources import readers, sinks


def one(df):
    return df.first().asDict()


def col(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()[0]


# --- names and filters ------------------------------------------------------------------------------


def test_species_names(spark):
    rows = spark.createDataFrame([("Quercus ROBUR",), ("Pinus sylvestris L.",), ("Acer pseudoplatanus subsp.",), (None,), ("",)], "s string")
    assert [r[0] for r in rows.select(names.first_binomial(F.col("s"))).collect()] == ["quercus robur", "pinus sylvestris", "acer pseudoplatanus", None, None]
    assert [r[0] for r in rows.select(names.exactly_two_words(F.col("s"))).collect()] == [True, False, False, None, False]
    assert col(spark, names.species_caps(F.col("s")), s="quercus ROBUR") == "Quercus robur"
    assert names.standard_trait_id("X.X4.") == "X4" and names.standard_trait_id("X1") == "X1"
    assert col(spark, names.two_lines(F.col("s")), s="Stem conduit element length") == "Stem conduit element\nlength"
    assert col(spark, names.year_of(F.col("s")), s="abcd-01") is None and col(spark, names.year_of(F.col("s")), s="1999-05-01") == 1999


def test_type_filter(spark):
    df = spark.createDataFrame([("Tree",), ("Shrub",), ("Grass",), ("Tree",)], "pft string")
    valid = {"Tree", "Shrub", "Grass"}
    assert clean.filter_types(df, "pft", "Tree", valid).count() == 2
    assert clean.filter_types(df, "pft", "Tree_Shrub", valid).count() == 3
    with pytest.raises(ValueError):
        clean.filter_types(df, "pft", "Moss", valid)


def test_outliers(spark):
    rows = [(f"s{i}", i / 10, float(i), i) for i in range(1, 51)] + [("o", 100.0, 200.0, 1000)]
    df = spark.createDataFrame(rows, "species string, X1 double, X4 double, X39 long")
    assert clean.drop_outliers(df, ["X1", "X4"], 0.1, 0.9).filter("species = 'o'").count() == 0
    nulled = clean.null_outliers(df, ["X1"], 0.1, 0.9)
    assert nulled.count() == 51 and nulled.filter("species = 'o'").first()["X1"] is None


def test_weights(spark):
    df = spark.createDataFrame([(1, "a", 2000), (1, "a", 2001), (1, None, 2000), (2, "b", None)], "k int, org string, yr int")
    got = {(r["k"], r["org"], r["yr"]): r["weight"] for r in clean.resurvey_weight(df, ["k", "org"], "yr").collect()}
    assert got == {(1, "a", 2000): 0.5, (1, "a", 2001): 0.5, (1, None, 2000): None, (2, "b", None): 1.0}
    single = spark.createDataFrame([("g",), ("g",)], "source string")
    assert {r["weight"] for r in clean.source_weights(single).collect()} == {1.0}
    flat = clean.reliability(spark.createDataFrame([(3,), (3,)], "n int"), "n")
    assert {r["reliability"] for r in flat.collect()} == {1.0}


def test_joins_and_upsert(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    twice = spark.createDataFrame([(1, 1), (1, 2)], "k int, w int")
    with pytest.raises(ValueError):
        clean.unique_join(a, twice, ["k"], "1:1")
    assert clean.unique_join(a, twice, ["k"], "1:m").count() == 2
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, clean.upsert(a, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    wide = assemble.outer_wide(assemble.union_long({"a": a.withColumn("value", F.lit(1.0)).drop("v"), "b": new.withColumn("value", F.lit(2.0)).drop("v")}), ["k"], "trait", "value", ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, None), (2, 1.0, 2.0), (3, None, 2.0)]
    assert assemble.align(a, {"z": "int", "k": "bigint"}).dtypes == [("z", "int"), ("k", "bigint")]


def test_holdout_is_exact(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 4 == 0, "s").otherwise("g"))
    out = clean.holdout(df, F.col("s") == "s", 0.1, stats.seeded("id"))
    assert out.filter("is_test").count() == 25 and out.filter("is_test AND s = 'g'").count() == 0 and out.count() == 1000


# --- statistics -------------------------------------------------------------------------------------


def test_community_weighted(spark):
    df = spark.createDataFrame([("p", float(v), w) for v, w in zip((1, 2, 3, 4), (0.4, 0.3, 0.2, 0.1))], "plot string, v double, w double")
    got = one(stats.community_stats(df, "plot", "v", "w", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    assert math.isclose(got["mean"], 2.0) and math.isclose(got["std"], 1.0) and (got["q25"], got["q50"], got["q75"]) == (1, 2, 3)


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 7 == 0 else i % 3, float(v), int(w)) for i, (v, w) in enumerate(zip(rng.choice(rng.normal(size=300), 3000), rng.integers(1, 9, 3000)))]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    near = {r["g"]: r for r in stats.nearest_quantiles(df, ["g"], "v", qs).collect()}
    weighted = {r["g"]: r for r in stats.weighted_quantiles(df, ["g"], "v", "w", qs).collect()}
    assert set(near) == {None, 0, 1, 2}
    for g in near:
        v, w = map(np.array, zip(*sorted((v, w) for k, v, w in rows if k == g)))
        for n, q in qs.items():
            assert near[g][n] == v[int(np.rint(q * (len(v) - 1)))]
            assert weighted[g][n] == v[min(len(v) - 1, np.searchsorted(np.cumsum(w), q * w.sum(), "left"))]


def test_unknown_statistic(spark):
    with pytest.raises(ValueError):
        stats.grouped_stats(spark.range(3), ["id"], "id", {"x": ("id", "nonsense")})


def test_empty_table(spark):
    df = spark.createDataFrame([], "g int, v double, w double")
    assert stats.weighted_stats(df, ["g"], "v", "w").count() == 0


def test_types(spark):
    df = spark.createDataFrame([(i, float(i), "abcde"[i - 1], i + 40000, i / 2) for i in range(1, 6)], "a long, b double, c string, d long, e double")
    assert stats.optimal_types(df) == {"a": "tinyint", "b": "tinyint", "c": "string", "d": "int", "e": "double"}


def test_caps_and_modes(spark):
    df = spark.createDataFrame([("a", "x", i) for i in range(5)] + [("a", "y", i) for i in range(5)] + [("b", "z", 1)], "g string, c string, i int")
    assert stats.cap_per_group(df, ["g"], 3, [F.col("i"), F.col("c")]).count() == 4
    got = {r["g"]: (r["c"], r["proportion"]) for r in stats.dominant_category(df, "g", "c", 0.5).collect()}
    assert got == {"a": ("x", 0.5), "b": ("z", 1.0)}


# --- diversity --------------------------------------------------------------------------------------


def _square(spark, extra=()):
    rows = [("p", f"s{i}", 0.25, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1), *extra])]
    return spark.createDataFrame(rows, "plot string, sp string, a double, t1 double, t2 double")


def test_simpson_rao_mpd(spark):
    p = diversity.proportions(_square(spark), "plot", "sp", "a", ["t1", "t2"])
    got = one(diversity.dissimilarity(p, "plot", "sp", ["t1", "t2"]))
    assert math.isclose(got["simpson"], 0.75) and math.isclose(got["rao"], 0.42677669529663687) and math.isclose(got["mpd"], 0.42677669529663687 / 0.75)
    alone = diversity.proportions(_square(spark).limit(1), "plot", "sp", "a", ["t1", "t2"])
    assert one(diversity.dissimilarity(alone, "plot", "sp", ["t1", "t2"]))["mpd"] is None


def test_evenness_and_richness(spark):
    even = diversity.evenness(np.array([[0.0], [1.0], [2.0]]), np.full(3, 1 / 3))
    assert abs(even - 1) < 0.01 and diversity.evenness(np.zeros((2, 1)), np.full(2, 0.5)) is None
    assert abs(diversity.evenness(np.array([[0.0], [0.001], [100.0]]), np.array([0.98, 0.01, 0.01]))) < 0.05
    assert diversity.hull_volume(np.array([[0, 0], [0, 1], [1, 0], [1, 1], [0.5, 0.5]])) == 1.0
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [[0.5, 0.5, 0.5]])
    assert math.isclose(diversity.hull_volume(cube), 1.0) and diversity.hull_volume(cube[:2]) is None
    got = one(diversity.functional_diversity(_square(spark, [(0.5, 0.5)]), "plot", "sp", "a", ["t1", "t2"]))
    assert got["sp_ric"] == 5 and got["f_ric"] == 1.0 and 0 < got["f_eve"] <= 1


# --- space ------------------------------------------------------------------------------------------


def test_distances_and_projections(spark):
    d = col(spark, geo.haversine(F.lit(-74.0060), F.lit(40.7128), F.lit(-0.1278), F.lit(51.5074)))
    assert abs(d / 5_570_000 - 1) < 0.01
    x, _ = geo.to_equal_area(F.lit(180.0), F.lit(0.0))
    assert abs(col(spark, x) - 17367530.445) < 1e-3
    assert col(spark, geo.utm_zone(F.lit(10.0), F.lit(50.0))) == "32U"
    e, n = geo.to_utm(F.lit(9.0), F.lit(0.0))
    assert abs(col(spark, e) - 500000) < 1e-6 and abs(col(spark, n)) < 1e-6
    e, n = geo.to_utm(F.lit(-0.1278), F.lit(51.5074))
    assert abs(col(spark, e) - 699316) < 5 and abs(col(spark, n) - 5710164) < 5
    assert col(spark, geo.crosses_antimeridian(F.array(F.lit(170.0), F.lit(-170.0)))) and not col(spark, geo.crosses_antimeridian(F.array(F.lit(10.0), F.lit(20.0))))
    row, c = geo.cell_index(F.lit(-180.5), F.lit(90.5), -180.0, 90.0, 1.0, 1.0)
    assert (col(spark, row), col(spark, c)) == (0, 0)  # toward zero


def test_rasters(spark):
    grid = spark.createDataFrame([(r, c, float(3 * r + c + 1)) for r in range(3) for c in range(3)], "row int, col int, v double")
    checker = spark.createDataFrame([(r, c, (r + c) % 2) for r in range(3) for c in range(3)], "row int, col int, k int")
    assert sorted(r["v"] for r in raster.mask(grid, checker, "k", [0]).collect()) == [1, 3, 5, 7, 9]
    assert [tuple(r) for r in raster.coarsen(grid, 2, ["v"], 3, 3).collect()] == [(0, 0, 3.0)]
    hole = grid.filter("NOT (row = 1 AND col = 1)")
    assert one(raster.fill_nearest(hole, spark.createDataFrame([(1, 1)], "row int, col int"), "v", 2))["v"] == 2.0
    p = raster.pack_column(grid, "v").withColumn("b", unpack(F.col("packed"), F.col("scale"), F.col("offset"), -32768))
    assert p.filter("abs(b - v) > scale / 2 + 1e-12").count() == 0
    q, _, _ = pack(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), 8, False)
    assert col(spark, q) == 0
    grown = raster.missing_bands(spark.createDataFrame([("m", 1)], "map string, band int"), spark.createDataFrame([("m", 1), ("m", 2)], "map string, band int"))
    assert [tuple(r) for r in grown.collect()] == [("m", 2)]


def test_spherical_and_variogram(spark):
    for h, want in ((0.0, 0.1), (1.5, 1.0), (2.0, 1.0)):
        assert math.isclose(col(spark, variogram.spherical(F.lit(h), 0.1, 0.9, 1.5)), want)
    h = np.linspace(0.1, 3, 30)
    nugget, sill, reach = variogram.fit_spherical(h, variogram.spherical_np(h, 0.2, 0.8, 1.5), np.ones(30))
    assert abs(nugget - 0.2) < 0.03 and abs(sill - 0.8) < 0.03 and abs(reach - 1.5) < 0.05
    pts = [(i * 20 + j, x, y, math.sin(x / 3) + math.cos(y / 2)) for i, x in enumerate(np.linspace(0, 10, 20).tolist()) for j, y in enumerate(np.linspace(0, 10, 20).tolist())]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double").withColumn("g", F.lit(1))
    got = {r["lag"]: (r["gamma"], r["pairs"]) for r in variogram.bins(df, ["g"], "id", "x", "y", "z", 1.5, 10).collect()}
    a = np.array([p[1:] for p in pts])
    i, j = np.triu_indices(len(a), 1)
    d = np.hypot(a[i, 0] - a[j, 0], a[i, 1] - a[j, 1])
    k, g = np.floor(d / 1.5).astype(int), 0.5 * (a[i, 2] - a[j, 2]) ** 2
    for lag in range(9):
        assert abs(got[lag][1] - (k == lag).sum()) <= 40 and abs(got[lag][0] - g[k == lag].mean()) < 0.01
    assert variogram.variogram_range(a[:50, 0], a[:50, 1], a[:50, 2]) == (0.0, 0)


def test_fill_at_any_distance(spark):
    """Against brute force: far holes, ties, a null as no data, no data at all."""
    cells = [(0, 0, 1.0), (3, 90, 2.0), (70, 5, 3.0), (71, 5, None), (70, 9, 4.0)]
    holes = [(r, c) for r in range(0, 140, 23) for c in range(0, 120, 19)] + [(70, 7), (400, -300)]
    known = [x for x in cells if x[2] is not None]
    holes = [h for h in holes if h not in {x[:2] for x in known}]
    want = {h: min(((x[0] - h[0]) ** 2 + (x[1] - h[1]) ** 2, *x) for x in known)[3] for h in holes}
    df, out = spark.createDataFrame(cells, "row int, col int, v double"), spark.createDataFrame(holes, "row int, col int")
    got = raster.fill_all_nearest(df, out, "v").collect()
    assert {(r["row"], r["col"]): r["v"] for r in got} == want and len(got) == len(holes)
    assert raster.fill_all_nearest(df.filter("v IS NULL"), out, "v").count() == 0


def test_variogram_ranges_of_cells_and_of_the_whole(spark):
    """All points of a large cell count, and a trait without a large cell has the global range."""
    rng = np.random.default_rng(3)
    field = lambda x, y: float(math.sin(x / 2) + math.cos(y / 3))
    pts = [("big", int(x > 5), x, y, field(x, y)) for x, y in rng.uniform(0, 10, (5000, 2)).tolist()]
    pts += [("thin", i % 10, x, y, field(x, y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (600, 2)).tolist())]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, t string, cell int, x double, y double, z double")
    got = {r["t"]: r for r in variogram.ranges(df, "t", "cell", "id", "x", "y", "z").collect()}
    assert set(got) == {"big", "thin"} and got["big"]["n_chunks"] == 2 and 4900 < got["big"]["n"] <= 5000
    a = np.array([p[2:] for p in pts if p[0] == "thin"])
    want, n = variogram.variogram_range(a[:, 0], a[:, 1], a[:, 2], 200, 30_000)
    assert n == 600 and want > 0
    assert all(got["thin"][c] == got["thin"]["global_range"] == pytest.approx(want) for c in ("mean", "median", "q05", "q95"))
    assert (got["thin"]["n"], got["thin"]["n_chunks"], got["thin"]["std"], got["thin"]["stability"]) == (600, 1, 0.0, 1.0)
    d, g = (np.concatenate(v) for v in zip(*variogram._distance_blocks(a[:, 0], a[:, 1], a[:, 2], 5000)))
    i, j = np.triu_indices(len(a), 1)
    assert np.allclose(d, np.hypot(a[i, 0] - a[j, 0], a[i, 1] - a[j, 1])) and np.allclose(g, 0.5 * (a[i, 2] - a[j, 2]) ** 2)


# --- transforms, scores, models ---------------------------------------------------------------------


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0, 2.0])
def test_power_round_trip(spark, lam):
    df = spark.createDataFrame([(x,) for x in (-5.0, -0.5, 0.0, 0.3, 10.0, None)], "x double")
    back = df.select("x", yeo_johnson_inverse(yeo_johnson(F.col("x"), F.lit(lam)), F.lit(lam)).alias("y")).collect()
    assert all((r["x"] is None and r["y"] is None) or abs(r["x"] - r["y"]) < 1e-9 for r in back)


def test_power_fit(spark):
    rng = np.random.default_rng(1)
    assert abs(fit_lambda(np.expm1(np.abs(rng.normal(3, 0.5, 4000))))) < 0.15 and abs(fit_lambda(rng.normal(0, 1, 4000)) - 1) < 0.15
    long = spark.createDataFrame([("a", float(x)) for x in rng.lognormal(1, 1, 500)] + [("b", 100.0 + float(x)) for x in rng.normal(size=500)], "trait string, value double")
    got = {r["trait"]: r for r in model.fit_power(long, gate=0.15).collect()}
    assert got["a"]["transformed"] and not got["b"]["transformed"] and got["b"]["lambda"] == 1.0
    back = model.apply_power(model.apply_power(long, model.fit_power(long)), model.fit_power(long), inverse=True)
    assert abs(back.agg(F.sum("value")).first()[0] - long.agg(F.sum("value")).first()[0]) < 1e-6


def test_power_fit_takes_all_values(spark):
    """More rows than a sample would hold, a third of them equal, and the order of rows without a say."""
    df = spark.range(150_000).select(F.lit("a").alias("trait"), F.when(F.col("id") % 3 == 0, 40.0).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 2500.0)).alias("value"))
    df = df.unionByName(spark.createDataFrame([("c", 5.0)] * 3 + [("m", x) for x in (-2.0, -1.0, 0.0, 0.5, 3.0, 9.0)], "trait string, value double"))
    whole = df.groupBy("trait").agg(F.collect_list("value").alias("v")).collect()
    want = {r["trait"]: fit_lambda(np.array(r["v"])) for r in whole}
    got = {r["trait"]: r for r in model.fit_power(df).collect()}
    assert want["c"] == 1.0 and all(abs(got[t]["lambda"] - want[t]) < 1e-5 for t in ("a", "m"))
    y = df.filter("trait = 'a'").select(yeo_johnson(F.col("value"), F.lit(want["a"])).alias("y")).agg(F.avg("y"), F.stddev_pop("y")).first()
    assert math.isclose(got["a"]["mean"], y[0], rel_tol=1e-4) and math.isclose(got["a"]["scale"], y[1], rel_tol=1e-4)


def test_transforms(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 5.0) for i in range(1, 6)], "X1 double, X4 double, k double")
    got = model.transform(df, "log", ["X1", "X4"])
    assert got.columns == ["k", "X1_ln", "X4_ln"] and model.log_transform(df, ["X1", "X4"], ["X4"]).columns == ["X4", "k", "X1_ln"]
    z = model.transform(df, "norm", ["X1"]).agg(F.avg("X1"), F.stddev_pop("X1")).first()
    assert abs(z[0]) < 1e-12 and math.isclose(z[1], 1.0)
    with pytest.raises(ValueError):
        model.transform(df, "cube", ["X1"])
    vec = df.select(F.array("X1", F.col("X1") * 2, F.col("X1") * 3).alias("x"))
    mean, rows, share = model.pca(vec, "x", 0.95)
    assert len(rows) == 1 and math.isclose(share[0], 1.0) and "pc1" in model.project(vec, "x", mean, rows).columns


def test_metrics(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(20)], "obs double, pred double")
    got = one(metrics.regression_metrics(df, []))
    assert got["r2"] == 1 and got["rmse"] == 0 and math.isclose(got["pearsonr"], 1)
    w = df.agg(metrics.weighted_pearson(F.col("obs"), -F.col("pred"), F.lit(2.0))).first()[0]
    assert math.isclose(w, -1)
    assert metrics.ks_p_value(0.5, 0, 10) == 0 and metrics.ks_p_value(0.0, 50, 50) == 1 and metrics.ks_p_value(0.9, 50, 50) < 1e-6
    assert col(spark, metrics.error_bar(F.lit(1.0), F.lit(5))) == 2.776 / math.sqrt(5)
    assert one(metrics.balance(spark.createDataFrame([(0,), (1,)], "fold int"), "fold", 2))["balance"] == 1.0
    half = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, None)], "c int, f int")
    assert {r["c"]: r["majority"] for r in metrics.majority(half, ["c"], "f", 2).collect()} == {1: 1, 2: None}


def test_folds_and_models(spark):
    cells = spark.range(60).withColumn("n", F.col("id") % 7 + 1)
    folds = model.assign_folds(cells, "id", "n", 6, 20)
    assert [r["count"] for r in folds.groupBy("fold").count().collect()] == [10] * 6
    assert model.pick_range({"a": 1.0, "b": 3.0}, strategy="mean") == 2.0 and model.pick_range({"a": 1.0}, custom=9.0) == 9.0
    with pytest.raises(ValueError):
        model.pick_range({"a": 1.0}, trait="z")
    df = spark.range(300).select("id", (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 13 * 2.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 2 == 0, "s").otherwise("g").alias("source"))
    m, pred = model.train_fold(df, ["a", "b"], "y", "fold", 0, source="source")
    assert pred.count() == 50 and one(metrics.regression_metrics(pred, [], "y"))["r2"] > 0.9
    imp = {r["feature"]: r["importance"] for r in model.permutation_importance(m, df, ["a", "b"], {"a": ["a"], "b": ["b"]}, "y", "id", 2).collect()}
    assert imp["a"] > imp["b"]


def test_every_fold_is_validated(spark):
    df = spark.range(240).select("id", (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 13 * 2.0 + F.col("id") % 5).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    got = {r["fold"]: r for r in model.cross_validate(df, ["a", "b"], "y", "fold").collect()}
    assert set(got) == {"0", "1", "2", "mean", "std"}
    for k in range(3):
        own = one(metrics.regression_metrics(model.train_fold(df, ["a", "b"], "y", "fold", k)[1], [], "y"))
        assert all(math.isclose(got[str(k)][m], own[m], rel_tol=1e-9) for m in metrics.METRICS)
    rmse = [got[str(k)]["rmse"] for k in range(3)]
    assert math.isclose(got["mean"]["rmse"], np.mean(rmse)) and math.isclose(got["std"]["rmse"], np.std(rmse, ddof=1))
    imp = model.fold_importance(df, ["a", "b"], {"a": ["a"], "b": ["b"]}, "y", "fold", "id", 2).collect()
    assert sorted((r["fold"], r["feature"], r["n"]) for r in imp) == [(k, f, 2) for k in range(3) for f in "ab"]
    assert all(r["p99_low"] <= r["importance"] <= r["p99_high"] and 0 <= r["p_value"] <= 1 for r in imp)
    m, val = model.train_fold(df, ["a", "b"], "y", "fold", 1)
    own = model.permutation_importance(m, val.drop("pred"), ["a", "b"], {"a": ["a"]}, "y", "id", 2).first()
    assert math.isclose(own["importance"], next(r["importance"] for r in imp if (r["fold"], r["feature"]) == (1, "a")), rel_tol=1e-9)


def test_student():
    """Values of printed tables."""
    assert all(abs(metrics.t_critical(0.99, n) - t) < 1e-3 for n, t in ((1, 63.657), (2, 9.925), (3, 5.841), (4, 4.604), (9, 3.250), (30, 2.750)))
    mean, std, n, p, low, high = metrics.one_sided([1.0, 2.0, 3.0])
    assert (mean, std, n) == (2.0, 1.0, 3) and abs(p - 0.03709) < 1e-4 and abs(high - mean - 9.925 / math.sqrt(3)) < 1e-3 and abs(low + high - 4) < 1e-9
    assert metrics.one_sided([0.0, 0.0])[3] == 0.5 and metrics.one_sided([-1.0, -1.0])[3] == 1.0 and metrics.one_sided([1.0])[3:] == (None, None, None)


def test_applicability(spark):
    train = spark.createDataFrame([(i, i % 2, [float(i), 0.0]) for i in range(20)], "id int, fold int, x array<double>")
    d = model.nearest_distance(train, train, "id", "x", "fold")
    assert d.count() == 20 and {r["dist"] for r in d.collect()} == {1.0}
    mean = model.mean_distance(train, "id", "x")
    assert math.isclose(mean.first()[0], np.abs(np.subtract.outer(np.arange(20), np.arange(20))).mean())
    assert sorted(map(tuple, model.nearest_distance(train, train, "id", "x", "fold", bound=0).collect())) == sorted(map(tuple, d.collect()))  # in blocks
    assert math.isclose(model.mean_distance(train, "id", "x", bound=0).first()[0], mean.first()[0])
    far = spark.createDataFrame([(1, [100.0, 0.0]), (2, [3.0, 0.0])], "id int, x array<double>")
    out = model.applicability(model.nearest_distance(far, train, "id", "x"), mean, model.di_threshold(d, mean))
    assert {r["id"]: r["aoa"] for r in out.collect()} == {1: True, 2: False}


# --- sources, sinks, streams ------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("t.csv", "species,x,junk\nQuércus,1.5,9\n".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    assert tuple(readers.read_zipped_csv(spark, str(tmp_path / "outer.zip"), ["in.zip", "t.csv"], "species string, x double").first()) == ("Quércus", 1.5)
    (tmp_path / "a.tsv").write_text("k\tv\n1\tNA\n")
    got = readers.na_strings_to_null(readers.read_any(spark, str(tmp_path / "a.tsv"), columns=["v"]))
    assert got.first()[0] is None
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.doc")
    (tmp_path / "r.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n1 2\n-9 4\n")
    cells = readers.read_raster_cells(spark, str(tmp_path / "r.asc"), readers.ascii_grid)
    assert sorted((r["row"], r["col"], r["value"]) for r in cells.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)]
    (tmp_path / "p.yaml").write_text("traits:\n  - X4 # Wood density\n  - Y\n")
    assert [tuple(r) for r in readers.trait_descriptions(spark, str(tmp_path / "p.yaml")).collect()] == [("X4", "Wood density")]
    assert readers.latest_run(["run_20250101_000000", "run_20260101_000000", "x"]) == "run_20260101_000000"
    stacked = readers.stack_rasters({"a": cells.select("row", "col", "value"), "b": cells.filter("row = 0").select("row", "col", "value")})
    assert stacked.count() == 3 and stacked.filter("b IS NULL").count() == 1


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    new = spark.createDataFrame([(1, 2.5)], "k int, v double")
    sinks.append_upsert(spark, new, path, ["k"])
    sinks.append_upsert(spark, spark.createDataFrame([(1, 3.5), (2, 1.0)], "k int, v double"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 3.5), (2, 1.0)]
    assert "| 1 | 2.500 |" in sinks.markdown(new, "T") and r"\toprule" in sinks.latex(new)


def test_stream(spark, tmp_path):
    from fieldloom.streaming.events import read_stream, windowed_stats
    from tests.conftest import SF

    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    q = windowed_stats(read_stream(spark, str(tmp_path / "in"), batch.schema)).writeStream.outputMode("complete").format("memory").queryName("w").start()
    try:
        q.processAllAvailable()
        assert spark.table("w").agg(F.sum("n")).first()[0] == batch.count()
    finally:
        q.stop()


def test_config_and_results(spark, tmp_path):
    from fieldloom.sources.config import collect_results, load_config

    (tmp_path / "a.json").write_text('{"fit": {"folds": 5, "seed": 1}, "x": 1}')
    (tmp_path / "b.json").write_text('{"fit": {"folds": 6}}')
    c = load_config(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert (c.fit.folds, c.fit.seed, c.x) == (6, 1, 1)
    with pytest.raises(AttributeError):
        _ = c.nothing
    for t in ("X1", "X2"):
        (tmp_path / "r" / t).mkdir(parents=True)
        (tmp_path / "r" / t / "fold_3.csv").write_text("r2\n0.5\n")
    got = collect_results(spark, str(tmp_path / "r" / "*"), r"(X\d+)/fold_(\d+)", ["trait", "fold"])
    assert sorted(map(tuple, got.collect())) == [(0.5, "X1", "3"), (0.5, "X2", "3")]
    folds = readers.read_folds(spark, str(tmp_path / "r" / "*"))
    assert {r["fold"] for r in folds.collect()} == {3}


# --- exact quantiles and running sums ---------------------------------------------------------------


def test_linear_quantiles_and_running_sums(spark):
    """Against numpy, with ties, nulls, empty groups and a group that holds most rows."""
    from fieldloom.operators.stats import linear_quantiles, running

    rng = np.random.default_rng(4)
    rows = [(int(g), float(v) if v >= 0 else None) for g, v in zip(rng.choice([0, 0, 0, 0, 1, 2], 3000), rng.choice([*range(-1, 40), 1e6], 3000))] + [(7, None), (8, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    qs = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.97, "e": 1.0}
    for r in linear_quantiles(df, ["g"], "v", qs).collect():
        own = [v for g, v in rows if g == r["g"] and v is not None]
        for n, q in qs.items():
            assert r[n] is None if not own else math.isclose(r[n], np.quantile(own, q), rel_tol=1e-12, abs_tol=1e-12)
    whole = linear_quantiles(df, [], "v", qs).first()
    assert all(math.isclose(whole[n], np.quantile([v for _, v in rows if v is not None], q), abs_tol=1e-12) for n, q in qs.items())
    keyed = [(i, float(v)) for i, v in enumerate(rng.choice(50, 900))]
    got = {r["i"]: (r["s"], r["n"], r["s_all"], r["n_all"]) for r in running(spark.createDataFrame(keyed, "i int, v double"), "v", [F.col("i")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    total = 0.0
    for n, (i, v) in enumerate(sorted(keyed, key=lambda r: (r[1], r[0])), 1):
        total += v
        assert got[i] == (total, n, sum(v for _, v in keyed), 900)


def test_ks_p_column(spark):
    from fieldloom.operators import metrics

    cases = [(0.0, 5, 5), (0.1, 50, 70), (0.4, 30, 20), (1.0, 9, 9), (0.3, 0, 4)]
    got = spark.createDataFrame([(float(d), float(n), float(m)) for d, n, m in cases], "d double, n double, m double").select(metrics.ks_p_column(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()
    assert all(math.isclose(r["p"], metrics.ks_p_value(*c), abs_tol=1e-12) for r, c in zip(got, cases))


def test_outline_of_hexagons(spark):
    from fieldloom.functions import geo

    row = spark.range(1).select(geo.hex_polygon(F.lit(2), F.lit(-1), 10.0).alias("p"), geo.hex_outline(F.lit(2), F.lit(-1), 10_000.0).alias("d")).first()
    centre = (10 * math.sqrt(3) * 1.5, -15.0)
    assert len(row["p"]) == 6 and all(math.isclose(math.hypot(p["x"] - centre[0], p["y"] - centre[1]), 10.0) for p in row["p"])
    assert all(abs(p["lon"]) < 1 and abs(p["lat"]) < 1 for p in row["d"])


def test_imputation_by_model(spark):
    from fieldloom.operators import model

    rows = [(i, float(i % 30), float(i % 7) if i % 11 else None, None if i % 8 == 3 else 3.0 * (i % 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    got = {r["k"]: r for r in model.impute_by_model(df, ["y"], ["a", "b"]).collect()}
    assert len(got) == 600 and all(got[k]["b"] == b for k, _, b, _ in rows)  # gaps in features stay
    assert all(got[k]["y"] == y for k, _, _, y in rows if y is not None) and np.mean([abs(got[k]["y"] - 3.0 * a) for k, a, _, y in rows if y is None]) < 3
    with pytest.raises(ValueError):
        model.impute_by_model(df, ["y"], ["y", "a"])


def test_all_diversity_indices_in_a_row(spark):
    from fieldloom.operators import diversity

    rows = [("p", s, 1.0, float(x), float(y)) for s, x, y in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 1, 1))] + [("q", "a", 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "plot string, s string, w double, x double, y double")
    for abundance in ("w", None):
        got = {r["plot"]: r for r in diversity.fd_metrics(df, "plot", "s", abundance, ["x", "y"]).collect()}
        assert got["p"]["sp_ric"] == 4 and math.isclose(got["p"]["f_ric"], 1.0) and math.isclose(got["p"]["f_div"], 0.42677669529663687 / 0.75) and math.isclose(got["p"]["f_red"], 1 - got["p"]["f_div"])
        assert got["q"]["sp_ric"] == 1 and got["q"]["f_ric"] is None and got["q"]["f_div"] is None


def test_reports_are_whole(spark):
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(30).toDF("k"), "T", 29)
    assert len(sinks.markdown(spark.range(300).toDF("k"), "T").split("\n")) == 304


def test_range_settings():
    from fieldloom.operators import model

    table = {"a": 2.0, "b": 4.0, "c": 9.0}
    assert model.pick_range(table, 7.0, stat="max") == 7.0 and model.pick_range(table, stat="max") == 9.0 and model.pick_range(table, trait="b") == 4.0 and model.pick_range(table, strategy="median") == 4.0


def test_holdout_is_exact_on_ties(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    out = clean.holdout(df, F.col("id") < 700, 0.33, F.col("k")).collect()
    assert sum(r["is_test"] for r in out) == 231 and all(r["id"] < 700 and r["k"] == 0 for r in out if r["is_test"]) and len(out) == 1000
    assert not any(r["is_test"] for r in clean.holdout(df, F.col("id") < 0, 0.5, F.col("k")).collect())
