"""Queries: sources and sinks, written and read back.

Files go to the folder of ``spark.checkpoint.dir``, which all executors share, and only in a local session
without that setting to the machine's own; they go with the driver.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import assemble, raster, stats
from fieldloom.plans.base import gridded, obs, query, rounded
from fieldloom.sources import config, readers, sinks
from fieldloom.sources.readers import table


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    at = f"{base.rstrip('/')}/fieldloom-io-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    """A small file."""
    path, fs = _path(spark, name)
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()
    return name


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


_SCHEMA = "p_partkey bigint, p_name string, p_size int, p_retailprice double"
_FORMATS = ("parquet", "csv", "csv.gz", "tsv", "json", "orc")


@query("read_formats", "SELECT f.format, p_partkey, p_name, p_retailprice FROM part, (VALUES " + ", ".join(f"('{f}')" for f in _FORMATS) + ") f(format)")
def read_formats(spark, sf_dir):
    """One table in every format, each read by its suffix and pruned to three columns."""
    df, at, out = _parts(spark, sf_dir), _folder(spark), []
    sinks.write_table(df, f"{at}/part.parquet")
    df.write.option("header", True).csv(f"{at}/part.csv")
    df.write.option("header", True).option("compression", "gzip").csv(f"{at}/part.csv.gz")
    df.write.option("header", True).option("sep", "\t").csv(f"{at}/part.tsv")
    df.write.json(f"{at}/part.json")
    df.write.orc(f"{at}/part.orc")
    for kind in _FORMATS:
        out.append(readers.read_any(spark, f"{at}/part.{kind}", _SCHEMA, ["p_partkey", "p_name", "p_retailprice"]).withColumn("format", F.lit(kind)))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


@query("read_partitioned", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
def read_partitioned(spark, sf_dir):
    """A table written by partitions, read back through a filter that prunes them."""
    at = _folder(spark)
    sinks.write_table(_parts(spark, sf_dir), f"{at}/part.parquet", ["p_size"])
    return readers.read_any(spark, f"{at}/part.parquet").filter("p_size BETWEEN 10 AND 12").select("p_partkey", "p_size")


@query("read_zipped_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_zipped_csv(spark, sf_dir):
    """A CSV in an archive in an archive."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # the nations of the world
    text = "\n".join(["n_nationkey,n_name,n_regionkey,unused", *[f"{a},{b},{c},x" for a, b, c in rows]])
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("nation.csv", text.encode("latin-1"))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
    path = _put(spark, f"{_folder(spark)}/outer.zip", outer.getvalue())
    return readers.read_zipped_csv(spark, path, ["inner.zip", "nation.csv"], "n_nationkey int, n_name string, n_regionkey int")


@query("na_strings", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS p_retailprice FROM part")
def na_strings(spark, sf_dir):
    """Marks of missing values in text become null, and text numbers numbers."""
    name = F.when(F.col("p_partkey") % 3 == 0, "NA").when(F.col("p_partkey") % 5 == 0, "NaN").otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").select("p_partkey", name.alias("p_name"), F.when(F.col("p_partkey") % 4 == 0, "NA").otherwise(F.col("p_retailprice").cast("string")).alias("p_retailprice"))
    return readers.na_strings_to_null(df).withColumn("p_retailprice", F.col("p_retailprice").cast("double"))


@query("trait_descriptions", "SELECT 'X' || p_partkey AS trait, p_name AS description FROM part")
def trait_descriptions(spark, sf_dir):
    """Descriptions from the comments of a configuration file."""
    at = f"{_folder(spark)}/params"
    line = F.concat(F.lit("traits:\n  # none\n  - Y1\n  - X"), F.col("p_partkey").cast("string"), F.lit("   #  "), F.col("p_name"), F.lit("  "))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(at)
    return readers.trait_descriptions(spark, at)


@query("read_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_lookup(spark, sf_dir):
    """A look-up from JSON, applied as a map."""
    names = {str(r[0]): r[1] for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()}  # a row a region
    got = readers.read_lookup(spark, _put(spark, f"{_folder(spark)}/names.json", json.dumps(names).encode()))
    lookup = F.create_map(*[F.lit(x) for kv in sorted(got.items()) for x in kv])
    return table(spark, sf_dir, "nation").select("n_name", F.element_at(lookup, F.col("n_regionkey").cast("string")).alias("r_name"))


@query("load_config", "SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 10 ELSE r_regionkey END::BIGINT AS level, 'all' AS source FROM region")
def load_config(spark, sf_dir):
    """A tree of settings from YAML, overridden by one from JSON."""
    regions = table(spark, sf_dir, "region").select("r_name", "r_regionkey").collect()  # a row a region
    at = _folder(spark)
    lines = ["# settings", "source: all  # of them", "regions:", *[f"  {n}:\n    level: {k}" for n, k in regions]]
    base = _put(spark, f"{at}/base.yaml", "\n".join(lines).encode())
    over = _put(spark, f"{at}/over.json", json.dumps({"regions": {n: {"level": k * 10} for n, k in regions if k % 2 == 0}}).encode())
    c = config.load_config(spark, base, over)
    return spark.createDataFrame([(n, c.regions[n].level, c.source) for n in c.regions], "name string, level bigint, source string")


@query("read_folds", "SELECT p_partkey, p_size, (p_partkey % 5)::INT AS fold FROM part")
def read_folds(spark, sf_dir):
    """CSV files of five folds, the fold from the path."""
    at = _folder(spark)
    for i in range(5):
        table(spark, sf_dir, "part").filter(F.col("p_partkey") % 5 == i).select("p_partkey", "p_size").write.option("header", True).csv(f"{at}/fold_{i}")
    return readers.read_folds(spark, f"{at}/fold_*").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_size", "fold")


@query("collect_results", "SELECT p_type AS trait, 'run_20250101_000000' AS run, count(*) AS n, max(p_size) AS top FROM part GROUP BY p_type")
def collect_results(spark, sf_dir):
    """Results in a folder each, with trait and run from the path."""
    at = _folder(spark)
    rows = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("top")).collect()  # a row a type
    for t, n, top in rows:
        _put(spark, f"{at}/{t}/run_20250101_000000/results.csv", f"n,top\n{n},{top}\n".encode())
    out = config.collect_results(spark, f"{at}/*/*/results.csv", r"/([^/]+)/(run_[^/]+)/results\.csv$", ["trait", "run"])
    return out.select(F.regexp_replace("trait", "%20", " ").alias("trait"), "run", F.col("n").cast("bigint").alias("n"), "top")


@query("latest_run", "SELECT 'run_' || strftime(max(o_orderdate), '%Y%m') || '01_000000' AS run FROM orders")
def latest_run(spark, sf_dir):
    """The newest of the runs that lie in a folder."""
    at = _folder(spark)
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMM")).distinct().collect()  # a row a month
    for (m,) in months:
        _put(spark, f"{at}/run_{m}01_000000/done", b"")
    _put(spark, f"{at}/run_99991231/done", b"")  # no run by its name
    return spark.createDataFrame([(readers.latest_run(readers.list_names(spark, f"{at}/*")),)], "run string")


@query("read_ascii_grid", 'WITH {obs} SELECT "row", "col", round(avg(v), 2) + 0e0 AS value FROM obs GROUP BY 1, 2')
def read_ascii_grid(spark, sf_dir):
    """A grid of cells as a raster file, read back as cells."""
    cells = rounded(gridded(spark, sf_dir).groupBy("row", "col").agg(F.avg("v").alias("v")), 2).collect()  # 18 x 36 cells at most
    grid = {(r["row"], r["col"]): r["v"] for r in cells}
    body = "\n".join(" ".join(repr(grid.get((i, j), -9999.0)) for j in range(36)) for i in range(18))
    path = _put(spark, f"{_folder(spark)}/map.asc", ("ncols 36\nnrows 18\nxllcorner -180\nyllcorner -90\ncellsize 10\nNODATA_value -9999.0\n" + body).encode())
    return readers.read_raster_cells(spark, path, readers.ascii_grid).select("row", "col", "value")


@query("stack_rasters", 'WITH {obs} SELECT "row", "col", round(avg(v) FILTER (source = \'F\'), 4) + 0e0 AS f, round(avg(v) FILTER (source = \'O\'), 4) + 0e0 AS o FROM obs GROUP BY 1, 2')
def stack_rasters(spark, sf_dir):
    """Two aligned maps as one wide table."""
    g = gridded(spark, sf_dir).groupBy("row", "col", "source").agg(F.avg("v").alias("value"))
    return rounded(readers.stack_rasters({s.lower(): g.filter(F.col("source") == s).select("row", "col", "value") for s in ("F", "O")}))


@query("band_difference", 'WITH {obs}, b AS (SELECT "row", "col", avg(v) AS a, avg(price) AS b, avg(size) AS c FROM obs GROUP BY 1, 2) SELECT "row", "col", round(a - b, 4) + 0e0 AS a_b, round(c, 4) + 0e0 AS c FROM b')
def band_difference(spark, sf_dir):
    """A band derived from two others, and only the bands that are kept."""
    bands = gridded(spark, sf_dir).groupBy("row", "col").agg(F.avg("v").alias("a"), F.avg("price").alias("b"), F.avg("size").alias("c"))
    return rounded(raster.prune_bands(raster.band_difference(bands, "a", "b", "a_b"), ["row", "col"], ["a_b", "c"]))


@query("safe_overwrite", "SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_size < 25")
def safe_overwrite(spark, sf_dir):
    """A table replaced by a query over itself, and an attempt that fails and leaves it as it is."""
    path = f"{_folder(spark)}/part"
    sinks.safe_overwrite(table(spark, sf_dir, "part").select("p_partkey", "p_size"), path)
    sinks.safe_overwrite(spark.read.parquet(path).filter("p_size < 25").withColumn("p_size", F.col("p_size") + 1), path)
    try:
        sinks.safe_overwrite(spark.read.parquet(path).withColumn("p_size", F.raise_error(F.lit("stop"))), path)
    except Exception as e:  # what Spark raises has no class of its own here
        if "stop" not in str(e):
            raise
    return spark.read.parquet(path)


@query("append_upsert", "SELECT p_type, CASE WHEN p_type LIKE 'S%' THEN 2 ELSE 1 END AS version, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def append_upsert(spark, sf_dir):
    """A results table by key, in which later rows win."""
    path = f"{_folder(spark)}/results"
    per = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.append_upsert(spark, per.select("p_type", F.lit(1).alias("version"), "n"), path, ["p_type"])
    sinks.append_upsert(spark, per.filter("p_type LIKE 'S%'").select("p_type", F.lit(2).alias("version"), "n"), path, ["p_type"])
    return spark.read.parquet(path)


_REPORT = "a AS (SELECT p_type, count(*) AS n, avg(p_retailprice) AS price, row_number() OVER (ORDER BY p_type) AS r FROM part GROUP BY p_type)"


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "at bigint, line string")


def _report(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("price")).orderBy("p_type")


@query("markdown_report", f"WITH {_REPORT} SELECT r + 3 AS \"at\", '| ' || p_type || ' | ' || n || ' | ' || format('{{:,.3f}}', price) || ' |' AS line FROM a UNION ALL SELECT * FROM (VALUES (0, '# Types'), (1, ''), (2, '| p_type | n | price |'), (3, '| --- | --- | --- |')) v(a, b)")
def markdown_report(spark, sf_dir):
    return _lines(spark, sinks.markdown(_report(spark, sf_dir), "Types"))


@query("latex_report", f"WITH {_REPORT} SELECT r + 3 AS \"at\", p_type || ' & ' || n || ' & ' || format('{{:.3f}}', price) || ' \\\\' AS line FROM a UNION ALL SELECT * FROM (VALUES (0, '\\begin{{tabular}}{{lll}}'), (1, '\\toprule'), (2, 'p\\_type & n & price \\\\'), (3, '\\midrule')) v(a, b) UNION ALL SELECT max(r) + 4, '\\bottomrule' FROM a UNION ALL SELECT max(r) + 5, '\\end{{tabular}}' FROM a")
def latex_report(spark, sf_dir):
    return _lines(spark, sinks.latex(_report(spark, sf_dir)))


@query("parameters_json", "SELECT p_type AS trait, k.key, CASE k.key WHEN 'lo' THEN min(p_size) WHEN 'hi' THEN max(p_size) END::BIGINT AS value FROM part, (VALUES ('lo'), ('hi')) k(key) GROUP BY p_type, k.key")
def parameters_json(spark, sf_dir):
    """A table of parameters as JSON, and back."""
    params = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("trait")).agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    text = sinks.parameters_json(params)
    parsed = F.from_json(F.lit(text), "map<string, map<string, bigint>>")
    return spark.range(1).select(F.explode(parsed).alias("trait", "own")).select("trait", F.explode("own").alias("key", "value"))


@query("legend_json", "WITH {obs}, q AS (SELECT pft, source, round_even(quantile_cont(v, 0.02), 4) AS p2, round_even(quantile_cont(v, 0.98), 4) AS p98 FROM obs GROUP BY 1, 2) SELECT pft, source, round(p2, 2) + 0e0 AS p2, round(p98, 2) + 0e0 AS p98 FROM q")
def legend_json(spark, sf_dir):
    """Nested legend metadata as JSON, type to source to its 2 and 98 percentiles, and back."""
    text = sinks.nested_metadata(obs(spark, sf_dir), "pft", "source", "v")
    back = text.select("pft", F.explode(F.from_json("json", "map<string, struct<p2: double, p98: double>>")).alias("source", "x"))
    return rounded(back.select("pft", "source", "x.p2", "x.p98"), 2)


@query("align_schemas", "SELECT p_partkey::INT AS p_partkey, NULL::DOUBLE AS score, p_size::VARCHAR AS p_size FROM part UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def align_schemas(spark, sf_dir):
    """Tables of unlike columns, brought to one schema and united."""
    schema = {"p_partkey": "int", "score": "double", "p_size": "string"}
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("score"), "s_name")
    return assemble.align(table(spark, sf_dir, "part"), schema).unionByName(assemble.align(suppliers, schema))


@query("stratified_sample", "SELECT p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS r FROM part) WHERE r <= 3")
def stratified_sample(spark, sf_dir):
    """Three parts of each size, in a seeded order: a sampling operator."""
    order = [F.md5(F.col("p_partkey").cast("string")), F.col("p_partkey")]
    return stats.cap_per_group(table(spark, sf_dir, "part").select("p_size", "p_partkey"), ["p_size"], 3, order)
