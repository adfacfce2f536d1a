"""Queries: scores of folds, hexagon outlines, flags, variogram limits, ladders and imputation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.functions.names import two_lines as broken
from fieldloom.operators import diversity, metrics, model, raster, stats, variogram
from fieldloom.plans.base import gridded, obs, query, rounded
from fieldloom.plans.modelling import _DBAR, _E, _NN, _T, _emb, _predictions, _train
from fieldloom.plans.spatial import _BASE, _VG, _q_sql, _raster, _vectors
from fieldloom.sources.readers import table

_KS = (
    "a AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), "
    "t AS (SELECT sum(na) AS n, sum(nb) AS m FROM a), c AS (SELECT sum(na) OVER (ORDER BY v) AS ca, sum(nb) OVER (ORDER BY v) AS cb FROM a), "
    "d AS (SELECT max(abs(ca / n - cb / m)) AS d, any_value(n)::DOUBLE AS n, any_value(m)::DOUBLE AS m FROM c, t), "
    "x AS (SELECT *, (sqrt(n * m / (n + m)) + 0.12e0 + 0.11e0 / sqrt(n * m / (n + m))) * d AS x FROM d), "
    "p AS (SELECT CASE WHEN x <= 0.2e0 THEN 1e0 ELSE least(1e0, greatest(0e0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * x * x))))) END AS p FROM x)"
)


def _ks(spark, sf_dir):
    ks = metrics.ks_statistic(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R")
    return ks.select("d", metrics.ks_p_column(F.col("d"), F.col("n").cast("double"), F.col("m").cast("double")).alias("p"))


@query("ks_p_value", f"WITH {_KS} SELECT round(d, 8) + 0e0 AS d, round(p, 6) + 0e0 AS p FROM x, p")
def ks_p_value(spark, sf_dir):
    """Distance of two distributions and its p-value."""
    return rounded(rounded(_ks(spark, sf_dir), 8, "d"), 6, "p")


@query("fold_similarity", f"WITH {_KS}, b AS (SELECT 1 / (1 + stddev_pop(n) / avg(n)) AS balance FROM (SELECT i, count(vec_id) AS n FROM range(12) r(i) LEFT JOIN embeddings ON label = i GROUP BY i)) SELECT w.weight, round(w.weight * p + (1 - w.weight) * balance, 6) + 0e0 AS score FROM p, b, (VALUES (0e0), (0.5e0), (1e0)) w(weight)")
def fold_similarity(spark, sf_dir):
    """Score of a deal of folds, by the weight of its distributions."""
    both = _ks(spark, sf_dir).crossJoin(F.broadcast(metrics.balance(table(spark, sf_dir, "embeddings"), "label", 12)))  # one row each
    weights = [F.struct(F.lit(w).alias("weight"), metrics.similarity(F.col("p"), F.col("balance"), w).alias("score")) for w in (0.0, 0.5, 1.0)]
    return rounded(both.select(F.explode(F.array(*weights)).alias("s")).select("s.*"), 6, "score")


@query("hex_polygons", "SELECT p_partkey, k::INT AS corner, round(1000 * sqrt(3e0) * (q + r / 2e0) + 1000 * cos(radians(30 + 60 * k)), 3) + 0e0 AS x, round(1500e0 * r + 1000 * sin(radians(30 + 60 * k)), 3) + 0e0 AS y FROM (SELECT p_partkey, p_partkey % 70 - 35 AS q, p_size % 50 - 25 AS r FROM part), range(6) t(k)")
def hex_polygons(spark, sf_dir):
    """Outlines of hexagons, a row a corner."""
    p = table(spark, sf_dir, "part").select("p_partkey", geo.hex_polygon(F.col("p_partkey") % 70 - 35, F.col("p_size") % 50 - 25, 1000.0).alias("c"))
    return rounded(p.select("p_partkey", F.posexplode("c").alias("corner", "c")).select("p_partkey", "corner", "c.x", "c.y"), 3)


@query("hex_polygon_holds_its_points", "SELECT count(*) AS n, 0::BIGINT AS outside FROM (SELECT DISTINCT p_partkey FROM part)")
def hex_polygon_holds_its_points(spark, sf_dir):
    """Points outside of the outline of their own hexagon, which are none: a point is left of each edge."""
    x, y = geo.to_equal_area((F.col("p_partkey") * 37 % 36000) / 100.0 - 180.0, (F.col("p_partkey") * 91 % 17000) / 100.0 - 85.0)
    q, r = geo.hex_cell(F.col("x"), F.col("y"), 250_000.0)
    p = table(spark, sf_dir, "part").select("p_partkey").distinct().select("p_partkey", x.alias("x"), y.alias("y")).withColumn("c", geo.hex_polygon(q, r, 250_000.0))
    left = lambda a, b: (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"]) >= -1.0
    inside = F.lit(True)
    for k in range(6):
        inside = inside & left(F.col("c")[k], F.col("c")[(k + 1) % 6])
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("outside"))


@query("aoa_inverted", f"WITH {_E}, {_DBAR}, {_NN}, {_T}, p AS (SELECT vec_id, list_transform(x, lambda v: v * 1.05e0 + 0.01e0) AS x FROM e), d AS (SELECT p.vec_id, min(list_distance(p.x, e.x)) AS dist FROM p, e GROUP BY 1) SELECT vec_id, round(dist / mean_distance, 4) + 0e0 AS di, dist / mean_distance <= threshold AS aoa FROM d, m, t")
def aoa_inverted(spark, sf_dir):
    """Applicability of moved vectors where true is inside."""
    e = _emb(spark, sf_dir)
    moved = e.select("vec_id", F.transform("x", lambda v: v * 1.05 + 0.01).alias("x"))
    mean = model.mean_distance(e, "vec_id", "x")
    out = model.applicability(model.nearest_distance(moved, e, "vec_id", "x"), mean, model.di_threshold(model.nearest_distance(e, e, "vec_id", "x", "fold"), mean), inverted=True)
    return rounded(out.select("vec_id", "di", "aoa"), 4)


_FLAGS = '{obs}, f AS (SELECT "row", "col", CASE count(*) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 7 END AS flag FROM obs GROUP BY 1, 2)'


@query("fill_flags", f'WITH {_FLAGS}, g AS (SELECT * FROM f WHERE flag IN (0, 1)), h AS (SELECT "row" AS hr, "col" AS hc FROM f WHERE flag IS NULL OR flag NOT IN (0, 1)) SELECT "row", "col", flag FROM g UNION ALL SELECT hr, hc, flag FROM (SELECT hr, hc, flag, row_number() OVER (PARTITION BY hr, hc ORDER BY (g."row" - hr) * (g."row" - hr) + (g."col" - hc) * (g."col" - hc), g."row", g."col") AS k FROM h JOIN g ON true) WHERE k = 1')
def fill_flags(spark, sf_dir):
    """Flags other than 0 and 1 are filled from the nearest cell that has one."""
    n = F.count(F.lit(1)) % 5
    f = gridded(spark, sf_dir).groupBy("row", "col").agg(F.when(n == 0, 0).when(n.isin(1, 2), 1).when(n == 3, 7).alias("flag"))
    return raster.fill_flags(f, "flag")


_PAIRS = "d AS (SELECT a.label, a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, 0.5e0 * (a.z - b.z) * (a.z - b.z) AS g, a.vec_id < b.vec_id AS once FROM q a JOIN q b ON a.label = b.label AND a.vec_id <> b.vec_id)"


@query("variogram_log_bins", f"WITH {_VG}, {_PAIRS} SELECT label, floor(8 * ln(h / 0.02e0) / ln(0.8e0 / 0.02e0))::INT AS lag, round(avg(g), 6) + 0e0 AS gamma, count(*) AS pairs FROM d WHERE once AND h >= 0.02e0 AND h < 0.8e0 GROUP BY 1, 2")
def variogram_log_bins(spark, sf_dir):
    """Experimental variogram over distance classes of one ratio."""
    return rounded(variogram.log_bins(_vectors(spark, sf_dir), ["label"], "vec_id", "x", "y", "z", 0.02, 0.8, 8), 6)


@query("variogram_limits", f"WITH {_VG}, {_PAIRS}, n AS (SELECT label, vec_id, min(h) AS h FROM d GROUP BY 1, 2), w AS (SELECT label, 0.7e0 * max(h) AS far FROM d GROUP BY 1), p AS (SELECT label, greatest(quantile_cont(h, 0.01), 0.01e0) AS near FROM n GROUP BY 1) SELECT label, round(far, 6) + 0e0 AS max_distance, round(near, 6) + 0e0 AS min_distance FROM w JOIN p USING (label)")
def variogram_limits(spark, sf_dir):
    """Least and greatest distance of a variogram, over all points of a label."""
    return rounded(variogram.distance_limits(_vectors(spark, sf_dir), ["label"], "vec_id", "x", "y", 0.01), 6)


@query("hex_resolution", "SELECT p_type, round((ln(n) - 7.3504e0) / -1.0274e0, 6) + 0e0 AS resolution, CASE WHEN n / 1e6 < 1e-4 THEN 1 WHEN n / 1e6 < 1e-3 THEN 2 WHEN n / 1e6 < 1e-2 THEN 3 WHEN n / 1e6 < 1e-1 THEN 4 ELSE 5 END AS level FROM (SELECT p_type, count(*)::DOUBLE AS n FROM part GROUP BY p_type)")
def hex_resolution(spark, sf_dir):
    """Resolutions by edge length and by density of samples, on the driver: a row a type."""
    rows = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).collect()
    return rounded(spark.createDataFrame([(t, geo.hex_resolution(float(n)), geo.resolution_for_density(n, 1e6)) for t, n in rows], "p_type string, resolution double, level int"), 6)


@query("two_lines", "SELECT p_partkey, CASE WHEN length(p_name) > 10 AND pos > length(p_name) // 2 THEN substr(p_name, 1, pos - 1) || chr(10) || substr(p_name, pos + 1) ELSE p_name END AS name FROM (SELECT p_partkey, p_name, CASE WHEN strpos(substr(p_name, length(p_name) // 2 + 1), ' ') > 0 THEN strpos(substr(p_name, length(p_name) // 2 + 1), ' ') + length(p_name) // 2 ELSE length(p_name) // 2 END AS pos FROM part)")
def two_lines(spark, sf_dir):
    """Long names in two lines."""
    return table(spark, sf_dir, "part").select("p_partkey", broken(F.col("p_name"), 10).alias("name"))


@query("pick_range", "WITH a AS (SELECT p_type, avg(p_retailprice) AS r FROM part GROUP BY p_type), f AS (SELECT min_by(r, p_type) AS first, avg(r) AS mean, median(r) AS median, min(r) AS min, max(r) AS max FROM a) SELECT k.how, round(CASE k.how WHEN 'custom' THEN 5e0 WHEN 'per_trait' THEN first WHEN 'mean' THEN mean WHEN 'median' THEN median WHEN 'min' THEN min WHEN 'max' THEN max WHEN 'older max' THEN max END, 4) + 0e0 AS range FROM f, (VALUES ('custom'), ('per_trait'), ('mean'), ('median'), ('min'), ('max'), ('older max')) k(how)")
def pick_range(spark, sf_dir):
    """The range that each setting picks from a table of ranges, a row a trait."""
    ranges = {t: r for t, r in table(spark, sf_dir, "part").groupBy("p_type").agg(F.avg("p_retailprice")).collect()}
    first = min(ranges)
    rows = [("custom", model.pick_range(ranges, 5.0, "max", first, "min")), ("older max", model.pick_range(ranges, None, "per_trait", first, "max"))]
    rows += [(how, model.pick_range(ranges, None, how, first)) for how in ("per_trait", "mean", "median", "min", "max")]
    return rounded(spark.createDataFrame([(how, float(r)) for how, r in rows], "how string, range double"))


@query("impute_values", "WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size FROM part), m AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(size, 0.5) AS ms FROM h) SELECT p_partkey, round(coalesce(price, mp), 4) + 0e0 AS price, round(coalesce(size, ms), 4) + 0e0 AS size FROM h, m")
def impute_values(spark, sf_dir):
    """Missing prices and sizes by exact medians."""
    h = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("size"))
    return rounded(model.impute(h, ["price", "size"]))


@query("impute_by_model")
def impute_by_model(spark, sf_dir):
    """Missing targets by trees over the other columns."""
    t = _train(spark, sf_dir).select("p_partkey", "size", "noise", "price", F.when(F.col("p_partkey") % 4 != 0, F.col("obs")).alias("obs"))
    return model.impute_by_model(t, ["obs"], ["size", "noise", "price"])


@query("train_and_predict")
def train_and_predict(spark, sf_dir):
    """A model of all rows, and its predictions."""
    t = _train(spark, sf_dir)
    features = ["size", "noise", "price"]
    return model.predict(model.train_full(t, features, "obs", "weight"), t, features).select("p_partkey", "obs", "pred")


@query("fd_metrics")
def fd_metrics(spark, sf_dir):
    """All five indices of functional diversity of every plot, by abundance."""
    return diversity.fd_metrics(obs(spark, sf_dir), "plot", "species_key", "w", ["size", "price"])


@query("fd_metrics_by_count")
def fd_metrics_by_count(spark, sf_dir):
    """The same where rows of a species count."""
    return diversity.fd_metrics(obs(spark, sf_dir), "plot", "species_key", None, ["size", "price"])


def _area(lat: str) -> str:
    q = lambda s: f"({1 - geo.E2!r} * ({s} / (1 - {geo.E2!r} * {s} * {s}) - ln((1 - {geo.E!r} * {s}) / (1 + {geo.E!r} * {s})) / (2 * {geo.E!r})))"
    return f"({q(f'sin(radians({lat} + 0.5e0))')} - {q(f'sin(radians({lat} - 0.5e0))')})"


@query("ellipsoidal_area_r", f"WITH op AS (SELECT l_returnflag AS trait, l_extendedprice AS x, l_quantity * p_retailprice AS y, (l_suppkey * 91 % 17000) / 100e0 - 85 AS lat FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT trait, x, y, {_area('lat')} / {_area('0e0')} AS w FROM op), m AS (SELECT trait, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1) SELECT trait, round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 5) + 0e0 AS r FROM w JOIN m USING (trait) GROUP BY trait")
def ellipsoidal_area_r(spark, sf_dir):
    """Pearson's r weighted by areas of one-degree cells on the ellipsoid."""
    df = _predictions(spark, sf_dir).withColumn("w", metrics.area_weight(F.col("lat"), 1.0))
    return rounded(df.groupBy("trait").agg(metrics.weighted_pearson(F.col("obs"), F.col("pred"), F.col("w")).alias("r")), 5)


def _utm_sql() -> str:
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius, c = geo.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(f"{x!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, x in enumerate(a, 1))
    north = " + ".join(f"{x!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, x in enumerate(a, 1))
    return f"""WITH p AS (SELECT p_partkey, (p_partkey * 37 % 36000) / 100e0 - 180 AS lon, (p_size * 3 % 160) - 79.5e0 AS lat FROM part),
s AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (least(floor((lon + 180) / 6), 59) * 6 - 177)) AS lam FROM p),
t AS (SELECT *, sinh(atanh(s) - {c!r} * atanh({c!r} * s)) AS t FROM s), k AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT p_partkey, round(500000 + {0.9996 * radius!r} * (eta + {east}), 3) + 0e0 AS easting, round(CASE WHEN lat < 0 THEN 1e7 ELSE 0e0 END + {0.9996 * radius!r} * (xi + {north}), 3) + 0e0 AS northing FROM k"""


@query("utm_coordinates", _utm_sql())
def utm_coordinates(spark, sf_dir):
    """Coordinates in each point's own zone."""
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37 % 36000) / 100.0 - 180.0).alias("lon"), (F.col("p_size") * 3 % 160 - 79.5).cast("double").alias("lat"))
    e, n = geo.to_utm(F.col("lon"), F.col("lat"))
    return rounded(p.select("p_partkey", e.alias("easting"), n.alias("northing")), 3)


# --- seeded choices ---------------------------------------------------------------------------------


def _hex_sql(edge: float) -> str:
    """The view ``hx``: obs with its hexagons."""
    return f"""e AS (SELECT *, radians(lon) * {geo.A * geo.K0!r} AS ex, {_q_sql('sin(radians(lat))')} * {geo.A / (2 * geo.K0)!r} AS ey FROM obs),
fa AS (SELECT *, ({math.sqrt(3) / 3!r} * ex - ey / 3) / {edge!r} AS q0, ({2 / 3!r} * ey) / {edge!r} AS r0 FROM e),
fb AS (SELECT *, round_even(q0, 0) AS rq, round_even(r0, 0) AS rr, round_even(-q0 - r0, 0) AS rs FROM fa),
fc AS (SELECT *, abs(rq - q0) AS dq, abs(rr - r0) AS dr, abs(rs - (-q0 - r0)) AS ds FROM fb),
hx AS (SELECT *, (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT AS q, (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS r FROM fc)"""


def _deal_sql(cells: str, key: str, k: int, sims: int) -> str:
    """The view ``dealt`` (key, fold): the most balanced of seeded deals of ``cells`` (key, n)."""
    return f"""dl AS (SELECT {key}, n, sim, ntile({k}) OVER (PARTITION BY sim ORDER BY ('0x' || substr(md5(concat_ws(':', {key}, sim, '42')), 1, 15))::BIGINT, {key}) - 1 AS fold FROM {cells}, range({sims}) s(sim)),
sc AS (SELECT sim, round(1 / (1 + stddev_pop(t) / avg(t)), 12) AS score FROM (SELECT sim, fold, sum(n) AS t FROM dl GROUP BY 1, 2) GROUP BY sim),
bs AS (SELECT sim FROM sc ORDER BY score DESC, sim LIMIT 1), dealt AS (SELECT {key}, fold::INT AS fold FROM dl WHERE sim = (SELECT sim FROM bs))"""


@query("spatial_thinning", f"WITH {{obs}}, {_hex_sql(5e5)} SELECT q, r, plot, species_key, v FROM (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY ('0x' || substr(md5(concat_ws(':', plot, species_key, org, '42')), 1, 15))::BIGINT, plot, species_key, org, v, w) AS k FROM hx) WHERE k <= 10")
def spatial_thinning(spark, sf_dir):
    """A seeded sample of at most 10 rows of each hexagon: a sampling operator."""
    df = obs(spark, sf_dir)
    q, r = geo.hex_cell_at(F.col("lon"), F.col("lat"), 500_000.0)
    order = [stats.shuffled("plot", "species_key", "org"), *map(F.col, ("plot", "species_key", "org", "v", "w"))]
    return stats.cap_per_group(df.withColumn("q", q).withColumn("r", r), ["q", "r"], 10, order).select("q", "r", "plot", "species_key", "v")


@query("fold_best_of_n", "WITH {obs}, " + _BASE + ', cl AS (SELECT "row" * 36 + "col" AS cell, n FROM g), ' + _deal_sql("cl", "cell", 5, 200) + " SELECT cell, fold FROM dealt")
def fold_best_of_n(spark, sf_dir):
    """The most balanced of 200 seeded deals of cells into five folds."""
    cells = _raster(spark, sf_dir).select((F.col("row") * 36 + F.col("col")).alias("cell"), "n")
    return model.assign_folds(cells, "cell", "n", 5, 200)


@query("hex_folds", f"WITH {{obs}}, {_hex_sql(5e5)}, hc AS (SELECT q, r, count(*) AS n, concat_ws('_', q, r) AS cell FROM hx GROUP BY 1, 2), cl AS (SELECT cell, n FROM hc WHERE n >= 20), " + _deal_sql("cl", "cell", 5, 200) + " SELECT cell, q, r, n, fold FROM hc LEFT JOIN dealt USING (cell)")
def hex_folds(spark, sf_dir):
    """Hexagons with their fold, hexagons without one kept."""
    q, r = geo.hex_cell_at(F.col("lon"), F.col("lat"), 500_000.0)
    cells = obs(spark, sf_dir).select(q.alias("q"), r.alias("r")).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.concat_ws("_", "q", "r"))
    return cells.join(model.assign_folds(cells.filter("n >= 20"), "cell", "n", 5, 200), "cell", "left")
