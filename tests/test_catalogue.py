"""Every registered analytics query: against its SQL, or at least to the end."""

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import catalogue
from tests.conftest import SF
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        assert same(df, duck.sql(catalogue.ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_registry_without_corpus_operators(tmp_path):
    """A copy without them, where deleting files has left their folder behind: the registry holds the rest."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).parent.parent
    shutil.copytree(top / "fieldloom", tmp_path / "fieldloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "fieldloom" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    names, sql = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.splitlines()
    assert names.split() == sorted(catalogue.QUERIES) and sql.split() == sorted(catalogue.ORACLE_SQL)


def test_whole_of_observations(spark):
    """No species and no observation is left out of the queries over all of them."""
    from fieldloom.plans.base import obs

    o, q = obs(spark, SF), catalogue.QUERIES
    assert q["antimeridian"](spark, SF).count() == o.select("species").distinct().count()
    got = {r["pft"]: (r["n_before"], r["species_before"]) for r in q["trait_coverage"](spark, SF).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in o.groupBy("pft").agg(F.count(F.lit(1)), F.countDistinct("species")).collect()}


def test_all_plot_statistics_on_the_grid(spark):
    """Each of the nine against weighted means of the plots' statistics in Python."""
    from fieldloom.operators import stats
    from fieldloom.plans.base import gridded

    names = ("mean", "std", *stats.WEIGHTED)
    q = catalogue.QUERIES
    got = {(r["row"], r["col"]): r for r in q["plot_stats_to_grid"](spark, SF).collect()}
    places = gridded(spark, SF).groupBy("plot").agg(F.sum("w").alias("pw"), F.min("lon").alias("lon"), F.min("lat").alias("lat")).toPandas().set_index("plot")
    plots = q["cwm_plot_stats"](spark, SF).toPandas().set_index("plot").join(places)
    plots["row"], plots["col"] = ((90 - plots["lat"]) / 10).astype(int), ((plots["lon"] + 180) / 10).astype(int)
    for at, g in plots.groupby(["row", "col"]):
        for c in names:
            assert abs(got[at][c] - (g["pw"] * g[c]).sum() / g["pw"].sum()) < 1e-3, (at, c)


def test_hexagons_on_the_meridian(spark, tmp_path):
    """Rows on the meridian of 0, an edge of every other row of hexagons, at all latitudes of the view: as in SQL."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE (18000 AS p_partkey) FROM '{SF}/part.parquet' LIMIT 1) TO '{tmp_path}/part.parquet'")
    c.sql(f"COPY (SELECT l.* REPLACE (18000 AS l_partkey, i AS l_suppkey) FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) l, range(17000) r(i)) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("hex_folds", "spatial_thinning"):
        assert same(catalogue.QUERIES[name](spark, str(tmp_path)), c.sql(catalogue.ORACLE_SQL[name])), name


def test_variogram_limits_over_whole_labels(spark, tmp_path):
    """Labels beyond 2,000 points, one on a ring, one in clusters: as in SQL, with the query's floor and without one."""
    import duckdb

    from fieldloom.operators import variogram
    from fieldloom.plans.spatial import _vectors

    c = duckdb.connect()
    c.sql(f"""COPY (SELECT 2500 * label + i AS vec_id, label, CASE label WHEN 0 THEN [cos(i), sin(i), 0e0] WHEN 1 THEN [i * 0.618034e0 % 1, i * 0.754878e0 % 1, 0e0]
      ELSE [i % 50 + (i * i % 97) * 1e-3, i % 49 + (i * 7 % 89) * 1e-3, 0e0] END AS embedding FROM range(2500) r(i), range(3) l(label)) TO '{tmp_path}/embeddings.parquet'""")
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert same(catalogue.QUERIES["variogram_limits"](spark, str(tmp_path)), c.sql(catalogue.ORACLE_SQL["variogram_limits"]))
    pairs = "d AS (SELECT a.label, a.vec_id, sqrt((a.embedding[1] - b.embedding[1]) ** 2 + (a.embedding[2] - b.embedding[2]) ** 2) AS h FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"
    want = c.sql(f"WITH {pairs}, n AS (SELECT label, min(h) AS h FROM d GROUP BY label, vec_id), q AS (SELECT label, quantile_cont(h, 0.01) AS near FROM n GROUP BY 1) SELECT label, max(h), any_value(near) FROM d JOIN q USING (label) GROUP BY 1").fetchall()
    got = {r["label"]: r for r in variogram.distance_limits(_vectors(spark, str(tmp_path)), ["label"], "vec_id", "x", "y", 0.0, 1.0).collect()}
    assert len(want) == 3
    for label, far, near in want:
        assert abs(got[label]["max_distance"] - far) < 1e-9 and abs(got[label]["min_distance"] - near) < 1e-12


def test_variogram_limits_of_odd_rows(spark):
    """Nulls, equal places, rows given twice, keys with two places and places that are not finite."""
    from fieldloom.operators import variogram

    nan, inf = float("nan"), float("inf")
    rows = [("null", 1, 0.0, 0.0), ("null", 2, None, 1.0), ("null", None, 9.0, 9.0), (None, 1, 0.0, 0.0), (None, 2, 1.0, 1.0), ("one", 1, 0.0, 0.0), ("one", 1, 5.0, 0.0), ("equal", 1, 2.0, 2.0), ("equal", 2, 2.0, 2.0)]
    rows += [("twice", 1, 0.0, 0.0), ("twice", 1, 0.0, 0.0), ("twice", 2, 3.0, 4.0), ("places", 1, 0.0, 0.0), ("places", 1, 10.0, 0.0), ("places", 2, 4.0, 0.0), ("inf", 1, inf, 0.0), ("inf", 2, 0.0, 0.0), ("inf", 3, 1.0, 0.0), ("nan", 1, nan, 0.0), ("nan", 2, 0.0, 0.0), ("nan", 3, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    got = {r["g"]: (r["max_distance"], r["min_distance"]) for r in variogram.distance_limits(df, ["g"], "k", "x", "y", 0.5, 1.0).collect()}
    assert str(got.pop("nan")) == "(nan, 1.0)"
    assert got == {"null": (None, 0.5), "equal": (0.0, 0.5), "twice": (5.0, 5.0), "places": (6.0, 4.0), "inf": (inf, 1.0)}
