"""Queries: projections, grids, rasters, variograms, folds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.functions.power import pack, unpack
from fieldloom.operators import metrics, model, raster, variogram
from fieldloom.operators.stats import running
from fieldloom.plans.base import gridded, lat_of, lon_of, obs, query, rounded
from fieldloom.sources.readers import table

_PT = "pt AS (SELECT p_partkey, (p_partkey * 37 % 36000) / 100e0 - 180 AS lon, (p_partkey * 91 % 16000) / 100e0 - 80 AS lat FROM part)"


def _points(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", lon_of(k).alias("lon"), (k * 91 % 16000 / 100.0 - 80.0).alias("lat"))


def _q_sql(s: str) -> str:
    return f"({1 - geo.E2!r} * ({s} / (1 - {geo.E2!r} * {s} * {s}) - ln((1 - {geo.E!r} * {s}) / (1 + {geo.E!r} * {s})) / {2 * geo.E!r}))"


@query("project_equal_area", f"WITH {_PT} SELECT p_partkey, round(radians(lon) * {geo.A * geo.K0!r}, 2) + 0e0 AS x, round({_q_sql('sin(radians(lat))')} * {geo.A / (2 * geo.K0)!r}, 2) + 0e0 AS y FROM pt")
def project_equal_area(spark, sf_dir):
    x, y = geo.to_equal_area(F.col("lon"), F.col("lat"))
    return rounded(_points(spark, sf_dir).select("p_partkey", x.alias("x"), y.alias("y")), 2)


@query("project_round_trip", f"WITH {_PT} SELECT p_partkey, round(lon, 6) + 0e0 AS lon, round(lat, 6) + 0e0 AS lat FROM pt")
def project_round_trip(spark, sf_dir):
    """To the equal-area plane and back gives the coordinates again."""
    p = _points(spark, sf_dir)
    lon, lat = geo.from_equal_area(*geo.to_equal_area(F.col("lon"), F.col("lat")))
    return rounded(p.select("p_partkey", lon.alias("lon"), lat.alias("lat")), 6)


@query("project_mercator", f"WITH {_PT} SELECT p_partkey, round(radians(lon) * {geo.A!r}, 2) + 0e0 AS x, round(ln(tan(radians(lat) / 2 + {math.pi / 4!r})) * {geo.A!r}, 2) + 0e0 AS y FROM pt")
def project_mercator(spark, sf_dir):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return rounded(_points(spark, sf_dir).select("p_partkey", x.alias("x"), y.alias("y")), 2)


@query("utm_zone", f"WITH {_PT} SELECT p_partkey, least(floor((lon + 180) / 6e0) + 1, 60)::INT::VARCHAR || substr('CDEFGHJKLMNPQRSTUVWX', least(floor((lat + 80) / 8e0) + 1, 20)::INT, 1) AS zone FROM pt")
def utm_zone(spark, sf_dir):
    return _points(spark, sf_dir).select("p_partkey", geo.utm_zone(F.col("lon"), F.col("lat")).alias("zone"))


@query(
    "haversine_pairs",
    f"WITH {_PT} SELECT p_partkey, round(2 * {geo.EARTH_RADIUS!r} * asin(sqrt(least(pow(sin(radians(40.7128e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.7128e0)) * pow(sin(radians(-74.006e0 - lon) / 2), 2), 1e0))), 1) + 0e0 AS metres FROM pt",
)
def haversine_pairs(spark, sf_dir):
    return rounded(_points(spark, sf_dir).select("p_partkey", geo.haversine(F.col("lon"), F.col("lat"), F.lit(-74.006), F.lit(40.7128)).alias("metres")), 1)


@query(
    "hex_bin",
    f"""WITH {_PT}, e AS (SELECT p_partkey, radians(lon) * {geo.A * geo.K0!r} AS x, {_q_sql('sin(radians(lat))')} * {geo.A / (2 * geo.K0)!r} AS y FROM pt),
a AS (SELECT p_partkey, ({math.sqrt(3) / 3!r} * x - y / 3) / 5e5 AS q, ({2 / 3!r} * y) / 5e5 AS r FROM e),
b AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM a),
c AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - (-q - r)) AS ds FROM b)
SELECT p_partkey, (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT AS q, (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS r FROM c""",
)
def hex_bin(spark, sf_dir):
    q, r = geo.hex_cell_at(F.col("lon"), F.col("lat"), 500_000.0)
    return _points(spark, sf_dir).select("p_partkey", q.alias("q"), r.alias("r"))


@query("rect_zones", f"WITH {_PT}, e AS (SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM pt) SELECT p_partkey, least(floor((lon - a) / ((b - a) / 9e0)) + 1, 10)::INT AS zx, least(floor((lat - c) / ((d - c) / 4e0)) + 1, 5)::INT AS zy FROM pt, e")
def rect_zones(spark, sf_dir):
    p = _points(spark, sf_dir)
    ends = F.broadcast(p.agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d")))  # one row
    return p.crossJoin(ends).select("p_partkey", geo.rect_zone(F.col("lon"), F.col("a"), F.col("b"), 10).alias("zx"), geo.rect_zone(F.col("lat"), F.col("c"), F.col("d"), 5).alias("zy"))


@query("antimeridian", "WITH {obs} SELECT species, bool_or(lon > 150) AND bool_or(lon < -150) AS crosses FROM obs GROUP BY species")
def antimeridian(spark, sf_dir):
    """Whether a species' extreme longitudes lie on both sides: the predicate on an array of two."""
    ends = obs(spark, sf_dir).groupBy("species").agg(F.array(F.min("lon"), F.max("lon")).alias("lons"))
    return ends.select("species", geo.crosses_antimeridian(F.col("lons")).alias("crosses"))


@query("reference_grid", 'SELECT r.i::INT AS "row", c.i::INT AS "col", round(-180 + (c.i + 0.5e0) * 5, 6) + 0e0 AS x, round(90 - (r.i + 0.5e0) * 5, 6) + 0e0 AS y FROM range(36) r(i), range(72) c(i)')
def reference_grid(spark, sf_dir):
    return raster.global_grid(spark, 5.0)


_BASE = 'g AS (SELECT "row", "col", avg(v) AS v, sum(w) AS w, count(*) AS n FROM obs GROUP BY 1, 2)'


def _raster(spark, sf_dir):
    return gridded(spark, sf_dir).groupBy("row", "col").agg(F.avg("v").alias("v"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


@query("dense_raster", "WITH {obs}, " + _BASE + ' SELECT r.i::INT AS "row", c.i::INT AS "col", round(v, 4) + 0e0 AS v FROM range(18) r(i) CROSS JOIN range(36) c(i) LEFT JOIN g ON g."row" = r.i AND g."col" = c.i')
def dense_raster(spark, sf_dir):
    """Sparse cells put on the whole grid."""
    return rounded(raster.global_grid(spark, 10.0).select("row", "col").join(_raster(spark, sf_dir).select("row", "col", "v"), ["row", "col"], "left"))


@query("equal_area_grid", f"WITH {{obs}}, e AS (SELECT radians(lon) * {geo.A * geo.K0!r} AS x, {_q_sql('sin(radians(lat))')} * {geo.A / (2 * geo.K0)!r} AS y, v FROM obs) SELECT trunc((7314540.831e0 - y) / 1e6)::INT AS \"row\", trunc((x + 17367530.445e0) / 1e6)::INT AS \"col\", count(*) AS n, round(avg(v), 4) + 0e0 AS v FROM e GROUP BY 1, 2")
def equal_area_grid(spark, sf_dir):
    g = raster.with_equal_area_cells(obs(spark, sf_dir), "lon", "lat", 1e6)
    return rounded(g.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v")))


@query("coarsen_mean", "WITH {obs}, " + _BASE + ' SELECT ("row" // 4)::INT AS "row", ("col" // 4)::INT AS "col", round(avg(v), 4) + 0e0 AS v FROM g WHERE "row" < 16 AND "col" < 36 GROUP BY 1, 2')
def coarsen_mean(spark, sf_dir):
    return rounded(raster.coarsen(_raster(spark, sf_dir), 4, ["v"], 18, 36))


@query("coarsen_sum", "WITH {obs}, " + _BASE + ' SELECT ("row" // 3)::INT AS "row", ("col" // 3)::INT AS "col", sum(n)::BIGINT AS n FROM g GROUP BY 1, 2')
def coarsen_sum(spark, sf_dir):
    return raster.coarsen(_raster(spark, sf_dir), 3, ["n"], 18, 36, "sum")


@query("ndvi_ratio", 'WITH {obs}, ' + _BASE + ' SELECT "row", "col", round_even((v - w) / nullif(v + w, 0) * 10000, 0)::SMALLINT AS ndvi FROM g')
def ndvi_ratio(spark, sf_dir):
    return _raster(spark, sf_dir).select("row", "col", raster.normalised_difference(F.col("v"), F.col("w")).alias("ndvi"))


_CLASS = '((("row" * 7 + "col" * 3) % 5) + 1)'


@query("mask_join", "WITH {obs}, " + _BASE + f' SELECT "row", "col", round(v, 4) + 0e0 AS v FROM g WHERE {_CLASS} IN (2, 4)')
def mask_join(spark, sf_dir):
    cells = raster.global_grid(spark, 10.0).select("row", "col", F.expr("((row * 7 + col * 3) % 5) + 1").alias("c"))
    return rounded(raster.mask(_raster(spark, sf_dir), cells, "c", [2, 4]).select("row", "col", "v"))


@query("reclassify", f'SELECT r.i::INT AS "row", c.i::INT AS "col", CASE ((r.i * 7 + c.i * 3) % 5) + 1 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 20 END::DOUBLE AS c FROM range(18) r(i), range(36) c(i)')
def reclassify(spark, sf_dir):
    cells = raster.global_grid(spark, 10.0).select("row", "col", F.expr("((row * 7 + col * 3) % 5) + 1").alias("c"))
    return raster.reclassify(cells, "c", {1: 10, 2: 10, 3: 20}).withColumn("c", F.col("c").cast("double"))


@query(
    "pack_int16",
    "WITH {obs}, " + _BASE + ', e AS (SELECT (max(v) - min(v)) / 65534 AS s, (max(v) + min(v)) / 2 AS o FROM g) SELECT "row", "col", round_even((v - o) / s, 0)::SMALLINT AS packed, round(s, 6) + 0e0 AS scale, round(o, 4) + 0e0 AS "offset", abs(v - (round_even((v - o) / s, 0) * s + o)) <= s * 0.5001 AS close FROM g, e',
)
def pack_int16(spark, sf_dir):
    p = raster.pack_column(_raster(spark, sf_dir), "v")
    back = unpack(F.col("packed"), F.col("scale"), F.col("offset"), -32768)
    out = p.select("row", "col", "packed", "scale", "offset", (F.abs(F.col("v") - back) <= F.col("scale") * 0.5001).alias("close"))
    return rounded(rounded(out, 6, "scale"), 4, "offset")


@query("pack_uint8", "WITH {obs}, " + _BASE + ', e AS (SELECT (max(n) - min(n)) / 254 AS s, min(n) - (max(n) - min(n)) / 254 AS o FROM g) SELECT "row", "col", round_even((n - o) / s, 0)::SMALLINT AS packed FROM g, e')
def pack_uint8(spark, sf_dir):
    """Unsigned: 0 is left for no data."""
    p = raster.pack_column(_raster(spark, sf_dir).withColumn("n", F.col("n").cast("double")), "n", 8, False)
    return p.select("row", "col", "packed")


@query(
    "nearest_fill",
    "WITH {obs}, " + _BASE + ', h AS (SELECT r.i AS hr, c.i AS hc FROM range(18) r(i), range(36) c(i)), o AS (SELECT hr, hc FROM h WHERE NOT EXISTS (SELECT 1 FROM g WHERE g."row" = hr AND g."col" = hc)) SELECT hr::INT AS "row", hc::INT AS "col", n FROM (SELECT hr, hc, n, row_number() OVER (PARTITION BY hr, hc ORDER BY (g."row" - hr) * (g."row" - hr) + (g."col" - hc) * (g."col" - hc), g."row", g."col") AS k FROM o JOIN g ON true) WHERE k = 1',
)
def nearest_fill(spark, sf_dir):
    """Every hole, however far from data."""
    r = _raster(spark, sf_dir).select("row", "col", "n")
    holes = raster.global_grid(spark, 10.0).select("row", "col").join(r, ["row", "col"], "left_anti")
    return raster.fill_all_nearest(r, holes, "n")


@query("resample_nearest", "WITH {obs}, " + _BASE + ' SELECT r.i::INT AS "row", c.i::INT AS "col", n::DOUBLE AS n FROM range(36) r(i) CROSS JOIN range(72) c(i) LEFT JOIN g ON g."row" = r.i // 2 AND g."col" = c.i // 2')
def resample_nearest(spark, sf_dir):
    """A 10 degree raster read at the centres of a 5 degree grid."""
    return raster.resample_nearest(raster.global_grid(spark, 5.0), _raster(spark, sf_dir), F.col("x"), F.col("y"), -180.0, 90.0, 10.0, 10.0, ["n"]).select("row", "col", F.col("n").cast("double").alias("n"))


@query("point_lookup", "WITH {obs} SELECT CASE WHEN \"row\" >= 12 THEN 0 ELSE " + _CLASS + " END AS c, count(*) AS n FROM obs GROUP BY 1")
def point_lookup(spark, sf_dir):
    """Class of each point; 0 outside of the class raster."""
    cells = raster.global_grid(spark, 10.0).filter("row < 12").select("row", "col", F.expr("((row * 7 + col * 3) % 5) + 1").alias("c"))
    return raster.lookup_class(gridded(spark, sf_dir), cells, "c").groupBy("c").agg(F.count(F.lit(1)).alias("n"))


_TWO = '"row", "col", source, avg(v) AS v FROM obs GROUP BY 1, 2, 3'


@query("combine_first", f"WITH {{obs}}, m AS (SELECT {_TWO}), a AS (SELECT * FROM m WHERE source = 'F' AND (\"row\" + \"col\") % 2 = 0), b AS (SELECT * FROM m WHERE source = 'O') SELECT \"row\", \"col\", round(coalesce(a.v, b.v), 4) + 0e0 AS v, CASE WHEN a.v IS NOT NULL THEN 's' ELSE 'g' END AS source FROM a FULL JOIN b USING (\"row\", \"col\")")
def combine_first(spark, sf_dir):
    m = gridded(spark, sf_dir).groupBy("row", "col", "source").agg(F.avg("v").alias("v"))
    return rounded(raster.combine_first(m.filter("source = 'F' AND (row + col) % 2 = 0"), m.filter("source = 'O'"), "v"))


@query("mosaic", f"WITH {{obs}}, m AS (SELECT {_TWO}) SELECT \"row\", \"col\", round(coalesce(a.v, b.v), 4) + 0e0 AS v FROM (SELECT * FROM m WHERE source = 'F' AND \"col\" < 20) a FULL JOIN (SELECT * FROM m WHERE source = 'O') b USING (\"row\", \"col\")")
def mosaic(spark, sf_dir):
    m = gridded(spark, sf_dir).groupBy("row", "col", "source").agg(F.avg("v").alias("v"))
    return rounded(raster.mosaic(m.filter("source = 'F' AND col < 20").drop("source"), m.filter("source = 'O'").drop("source")))


@query("zonal_mean", 'WITH {obs}, ' + _BASE + ' SELECT "row", round(avg(v), 4) + 0e0 AS v, count(*) AS n FROM g GROUP BY 1')
def zonal_mean(spark, sf_dir):
    return rounded(_raster(spark, sf_dir).groupBy("row").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")))


# --- variograms -------------------------------------------------------------------------------------

_VG = "q AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_BINS = "d AS (SELECT a.label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, 0.5e0 * (a.z - b.z) * (a.z - b.z) AS g FROM q a JOIN q b ON a.label = b.label AND a.vec_id < b.vec_id), k AS (SELECT label, floor(h / 0.05e0)::INT AS lag, avg(g) AS gamma, count(*) AS pairs FROM d WHERE floor(h / 0.05e0) < 12 GROUP BY 1, 2)"


def _vectors(spark, sf_dir):
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", e[0].alias("x"), e[1].alias("y"), e[2].alias("z"))


@query("variogram_bins", f"WITH {_VG}, {_BINS} SELECT label, lag, round(gamma, 6) + 0e0 AS gamma, pairs FROM k")
def variogram_bins(spark, sf_dir):
    return rounded(variogram.bins(_vectors(spark, sf_dir), ["label"], "vec_id", "x", "y", "z", 0.05, 12), 6)


@query("variogram_valid_lags", f"WITH {_VG}, {_BINS} SELECT label, lag, round(gamma, 6) + 0e0 AS gamma, pairs FROM (SELECT *, max(pairs) OVER (PARTITION BY label) AS m FROM k) WHERE pairs >= greatest(20, 0.3 * m)")
def variogram_valid_lags(spark, sf_dir):
    return rounded(variogram.valid_lags(variogram.bins(_vectors(spark, sf_dir), ["label"], "vec_id", "x", "y", "z", 0.05, 12), ["label"], 20, 0.3), 6)


@query("spherical_eval", "SELECT p_partkey, round(CASE WHEN p_size <= 30 THEN 0.1e0 + 0.9e0 * (1.5e0 * (p_size / 30e0) - 0.5e0 * pow(p_size / 30e0, 3)) ELSE 1e0 END, 6) + 0e0 AS gamma FROM part")
def spherical_eval(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", variogram.spherical(F.col("p_size").cast("double"), 0.1, 0.9, 30.0).alias("gamma")), 6)


#: Hexagon edges in metres, by the number of cells up to which a trait's resolution holds: areas are those of the published index's resolutions 0 to 5.
_EDGES = tuple((n, math.sqrt(2 * area / (3 * math.sqrt(3))) * 1e3) for n, area in ((122, 4_357_449.4), (842, 609_788.4), (5_882, 86_801.8), (41_162, 12_393.4), (288_122, 1_770.3), (None, 252.9)))


@query("variogram_range")
def variogram_range(spark, sf_dir):
    """Correlation ranges of a trait from the variograms of its hexagons, for about 5,000 points a hexagon, and of the trait as a whole."""
    x, y = geo.to_equal_area(F.col("lon"), F.col("lat"))
    df = gridded(spark, sf_dir).groupBy("pft", "lon", "lat").agg(F.avg("v").alias("z"), F.min("plot").alias("plot")).withColumn("x", x).withColumn("y", y)
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") / 5000))
    edge = F.coalesce(*[F.when(wanted <= n, F.lit(e)) if n else F.lit(e) for n, e in _EDGES])
    edges = df.groupBy("pft").agg(F.count(F.lit(1)).alias("_n")).select("pft", edge.alias("edge"))
    q, r = geo.hex_cell(F.col("x"), F.col("y"), F.col("edge"))
    df = df.join(edges, "pft").withColumn("cell", F.concat_ws("_", q, r)).withColumn("id", F.xxhash64("lon", "lat"))
    return variogram.ranges(df, "pft", "cell", "id", "x", "y", "z")


# --- folds ------------------------------------------------------------------------------------------


@query("fold_ntile", 'WITH {obs}, ' + _BASE + ' SELECT "row", "col", ntile(6) OVER (ORDER BY "row", "col") - 1 AS fold FROM g')
def fold_ntile(spark, sf_dir):
    """Cells in six nearly equal folds, in key order so that SQL can follow."""
    ranked = running(_raster(spark, sf_dir).select("row", "col"), "row", [F.col("col")], {"r": F.lit(1)})
    size, more = F.floor(F.col("r_all") / 6), F.col("r_all") % 6  # the first folds have one more
    at = F.col("r") - 1
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranked.select("row", "col", fold.cast("int").alias("fold"))


@query("fold_balance", "SELECT round(1 / (1 + stddev_pop(n) / avg(n)), 8) + 0e0 AS balance FROM (SELECT i, count(vec_id) AS n FROM range(12) r(i) LEFT JOIN embeddings ON label = i GROUP BY i)")
def fold_balance(spark, sf_dir):
    return rounded(metrics.balance(table(spark, sf_dir, "embeddings"), "label", 12), 8)


@query("harmonise_raster", "WITH {obs}, " + _BASE + f' SELECT r.i::INT AS "row", c.i::INT AS "col", round_even(least(greatest(v, 30000), 50000) / 10, 0)::SMALLINT AS v FROM range(36) r(i) CROSS JOIN range(72) c(i) JOIN g ON g."row" = r.i // 2 AND g."col" = c.i // 2 WHERE ((r.i * 7 + c.i * 3) % 5) + 1 IN (2, 4)')
def harmonise_raster(spark, sf_dir):
    """Resampled to a finer grid, masked, clipped and cast: one composition."""
    from fieldloom.functions.names import clip

    fine = raster.resample_nearest(raster.global_grid(spark, 5.0), _raster(spark, sf_dir), F.col("x"), F.col("y"), -180.0, 90.0, 10.0, 10.0, ["v"]).dropna(subset=["v"])
    classes = raster.global_grid(spark, 5.0).select("row", "col", F.expr("((row * 7 + col * 3) % 5) + 1").alias("c"))
    return raster.mask(fine, classes, "c", [2, 4]).select("row", "col", F.rint(clip(F.col("v"), 30000.0, 50000.0) / 10).cast("short").alias("v"))


@query(
    "ks_statistic",
    "WITH a AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), t AS (SELECT sum(na) AS n, sum(nb) AS m FROM a) SELECT round(max(d), 8) + 0e0 AS d, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m FROM (SELECT abs(sum(na) OVER (ORDER BY v) / n - sum(nb) OVER (ORDER BY v) / m) AS d, n, m FROM a, t)",
)
def ks_statistic(spark, sf_dir):
    return rounded(metrics.ks_statistic(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R"), 8)
