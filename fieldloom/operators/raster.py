"""Rasters as cell tables: grids, gridding of points, masks, packing, coarsening, filling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.functions.power import pack


def reference_grid(spark: SparkSession, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, digits: int = 6) -> DataFrame:
    """(row, col, x, y) of every cell centre of a north-up grid."""
    cells = spark.range(nx * ny).select((F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    return cells.select("row", "col", F.round(x0 + (F.col("col") + 0.5) * dx, digits).alias("x"), F.round(y0 - (F.col("row") + 0.5) * dy, digits).alias("y"))


def global_grid(spark: SparkSession, degrees: float) -> DataFrame:
    return reference_grid(spark, -180.0, 90.0, degrees, degrees, round(360 / degrees), round(180 / degrees))


def with_cells(df: DataFrame, lon: str, lat: str, degrees: float) -> DataFrame:
    """Adds (row, col) of the geographic grid of that resolution."""
    row, col = geo.cell_index(F.col(lon), F.col(lat), -180.0, 90.0, degrees, degrees)
    return df.withColumn("row", row).withColumn("col", col)


def with_equal_area_cells(df: DataFrame, lon: str, lat: str, metres: float) -> DataFrame:
    """Adds (row, col) of the global equal-area grid of that cell size."""
    x, y = geo.to_equal_area(F.col(lon), F.col(lat))
    row, col = geo.cell_index(x, y, -17367530.445, 7314540.831, metres, metres)
    return df.withColumn("row", row).withColumn("col", col)


def coarsen(df: DataFrame, factor: int, values: list[str], n_rows: int, n_cols: int, how: str = "mean") -> DataFrame:
    """Blocks of factor x factor cells by mean or sum over cells with data; incomplete edge blocks are trimmed."""
    whole = (F.col("row") < n_rows // factor * factor) & (F.col("col") < n_cols // factor * factor)
    f = {"mean": F.avg, "sum": F.sum}[how]
    return df.filter(whole).groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(*[f(v).alias(v) for v in values])


def mask(df: DataFrame, classes: DataFrame, column: str, keep: list[int]) -> DataFrame:
    """Cells whose class is kept."""
    return df.join(classes.filter(F.col(column).isin(keep)).select("row", "col"), ["row", "col"], "left_semi")


def reclassify(df: DataFrame, column: str, mapping: Mapping[int, int]) -> DataFrame:
    """Codes replaced by their class; others become null."""
    return df.withColumn(column, F.create_map(*[F.lit(x) for p in mapping.items() for x in p])[F.col(column)])


def normalised_difference(a: Column, b: Column, scale: int = 10000) -> Column:
    """(a - b) / (a + b) scaled to an integer, half to even; null where the sum is 0."""
    return F.rint(F.try_divide(a - b, a + b) * scale).cast("short")


def band_difference(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the band ``a - b``, null where either is."""
    return df.withColumn(name, F.col(a) - F.col(b))


def prune_bands(df: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``keys`` and the bands of the keep list, in its order; an unknown one is an error."""
    if absent := [c for c in keep if c not in df.columns]:
        raise ValueError(f"no bands {absent}")
    return df.select(*keys, *keep)


def pack_column(df: DataFrame, column: str, bits: int = 16, signed: bool = True) -> DataFrame:
    """Adds packed, scale and offset by the column's own range."""
    ends = F.broadcast(df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))  # one row
    p, scale, offset = pack(F.col(column), F.col("_lo"), F.col("_hi"), bits, signed)
    return df.crossJoin(ends).withColumn("packed", p).withColumn("scale", scale).withColumn("offset", offset).drop("_lo", "_hi")


def resample_nearest(target: DataFrame, source: DataFrame, x: Column, y: Column, x0: float, y0: float, dx: float, dy: float, values: list[str]) -> DataFrame:
    """Values of the source cell that holds each target centre, given in source coordinates (x, y)."""
    row, col = geo.cell_index(x, y, x0, y0, dx, dy)
    keyed = target.withColumn("_r", row).withColumn("_c", col)
    return keyed.join(source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *values), ["_r", "_c"], "left").drop("_r", "_c")


def fill_nearest(df: DataFrame, holes: DataFrame, value: str, reach: int) -> DataFrame:
    """Holes (row, col) with the value of the nearest cell with data within ``reach`` cells (ties: least row, then column).

    Each hole looks at the offsets of its neighbourhood, an equi-join on integers: (2 reach + 1)**2 rows a hole at most, whatever the raster's size."""
    offsets = sorted(((i * i + j * j, i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    around = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(j).alias("j")) for d, i, j in offsets if d <= reach * reach]))
    looks = holes.select("row", "col", around.alias("o")).select("row", "col", "o.d", (F.col("row") + F.col("o.i")).alias("_r"), (F.col("col") + F.col("o.j")).alias("_c"))
    near = looks.join(df.filter(F.col(value).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), value), ["_r", "_c"])
    return near.groupBy("row", "col").agg(F.min_by(value, F.struct("d", "_r", "_c")).alias(value))


def fill_all_nearest(df: DataFrame, holes: DataFrame, value: str, reach: int = 4) -> DataFrame:
    """Every hole (row, col) with the value of the nearest cell with data at any distance (ties: least row, then column); none without data.

    Rings of double the reach serve the holes that are left, and look only at rows and columns between the data's ends. The result is persisted."""
    data = df.filter(F.col(value).isNotNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), value)
    ends = [F.min("_r"), F.max("_r"), F.min("_c"), F.max("_c")]
    r0, r1, c0, c1 = data.agg(*ends).first()
    if r0 is None:
        return holes.select("row", "col").join(data.select(value), F.lit(True)).limit(0)
    state, done = holes.select("row", "col", F.lit(None).cast(df.schema[value].dataType).alias(value)), -1
    while True:
        span = lambda c, lo, hi: F.sequence(F.greatest(F.col(c) - reach, F.lit(lo)), F.least(F.col(c) + reach, F.lit(hi)))  # noqa: B023, E731
        inside = F.col("row").between(r0 - reach, r1 + reach) & F.col("col").between(c0 - reach, c1 + reach)
        looks = state.filter(F.col(value).isNull() & inside).select("row", "col", F.explode(span("row", r0, r1)).alias("_r")).select("*", F.explode(span("col", c0, c1)).alias("_c"))
        d = F.pow(F.col("_r") - F.col("row"), 2) + F.pow(F.col("_c") - F.col("col"), 2)
        near = looks.withColumn("_d", d).filter((F.col("_d") <= reach * reach) & (F.col("_d") > done * done if done > 0 else F.lit(True))).join(data, ["_r", "_c"])
        found = near.groupBy("row", "col").agg(F.min_by(value, F.struct("_d", "_r", "_c")).alias("_v"))
        last, state = state, state.join(found, ["row", "col"], "left").select("row", "col", F.coalesce(value, "_v").alias(value)).persist()
        left = state.filter(F.col(value).isNull() & F.col("row").isNotNull() & F.col("col").isNotNull()).count()
        if done > 0:
            last.unpersist()
        if not left:
            return state.filter(F.col(value).isNotNull())
        done, reach = reach, 2 * reach


def fill_flags(df: DataFrame, flag: str) -> DataFrame:
    """Cells (row, col, flag): values other than 0 and 1 are holes, and each hole has the flag of the nearest cell with one."""
    clean = df.select("row", "col", F.when(F.col(flag).isin(0, 1), F.col(flag)).alias(flag))
    return clean.filter(F.col(flag).isNotNull()).unionByName(fill_all_nearest(clean, clean.filter(F.col(flag).isNull()), flag))


def lookup_class(points: DataFrame, classes: DataFrame, column: str, default: int = 0) -> DataFrame:
    """Class of each point's (row, col); outside of the raster, ``default``."""
    return points.join(classes.select("row", "col", column), ["row", "col"], "left").withColumn(column, F.coalesce(column, F.lit(default)))


def mosaic(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of rasters; on shared cells the earliest raster wins."""
    parts = [p.withColumn("_o", F.lit(i)) for i, p in enumerate((first, *others))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in ("row", "col", "_o")]
    return whole.groupBy("row", "col").agg(F.min_by(F.struct(*rest), F.struct("_o", *rest)).alias("_x")).select("row", "col", "_x.*")


def combine_first(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Values of ``a``, else of ``b``, with the source 's' or 'g' and which of the two had data."""
    x, y = a.select("row", "col", F.col(value).alias("_a")), b.select("row", "col", F.col(value).alias("_b"))
    return x.join(y, ["row", "col"], "full").select("row", "col", F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "s").when(F.col("_b").isNotNull(), "g").alias("source"))


def final_product(predicted: DataFrame, cov: DataFrame, aoa: DataFrame) -> DataFrame:
    """The three bands of a map, cell by cell; cells without a prediction are left out."""
    return predicted.join(cov, ["row", "col"], "left").join(aoa, ["row", "col"], "left")


def missing_bands(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bands of (map, band) that are still to be written."""
    return wanted.join(existing, ["map", "band"], "left_anti")
