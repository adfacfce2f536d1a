"""Registration of queries and the domain's views over the driver's tables.

``obs`` plays the occurrences: lineitem with the species and plant type of its part, a survey year,
coordinates derived from keys, an integral weight (quantity) and a measured value (price).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEGREES = 10.0


def query(name: str, sql: str | None = None):
    """Register a query and, if it has one, its SQL; ``{obs}`` in it stands for the view's definition, and
    ``round(x, d) + 0e0`` for the rounding of :func:`rounded`."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _shifted(sql.replace("{obs}", OBS_SQL))
        return f

    return add


def lon_of(c):
    return (c * 37 % 36000) / 100.0 - 180.0


def lat_of(c):
    return (c * 91 % 17000) / 100.0 - 85.0


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("plot"), F.col("l_partkey").alias("species_key"), F.col("p_name").alias("species"), F.col("p_type").alias("pft"), F.col("l_suppkey").alias("org"),
        F.year("l_shipdate").alias("yr"), F.col("l_linestatus").alias("source"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("v"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        lon_of(F.col("l_partkey")).alias("lon"), lat_of(F.col("l_suppkey")).alias("lat"),
    )


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.raster import with_cells

    return with_cells(obs(spark, sf_dir), "lon", "lat", DEGREES)


#: The same view in SQL, with its grid cells.
OBS_SQL = f"""obs AS (
  SELECT *, trunc((90 - lat) / 10e0)::INT AS "row", trunc((lon + 180) / 10e0)::INT AS "col" FROM (
    SELECT l_orderkey AS plot, l_partkey AS species_key, p_name AS species, p_type AS pft, l_suppkey AS org, year(l_shipdate)::INT AS yr,
           l_linestatus AS source, l_quantity AS w, l_extendedprice AS v, p_size AS size, p_retailprice AS price,
           (l_partkey * 37 % 36000) / 100e0 - 180 AS lon, (l_suppkey * 91 % 17000) / 100e0 - 85 AS lat
    FROM lineitem JOIN part ON l_partkey = p_partkey))"""


#: Share of the last digit that is added before rounding, here and in SQL: means of prices lie on ties of the last digit, where sums in another order would round apart.
TIE = 0.0321


def _shifted(sql: str) -> str:
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        if sql[j:].startswith(" + 0e0") and sql[i - 1 : i] != "_":
            digits = int(sql[comma + 1 : j - 1])
            out.append(f"{sql[at:i]}round(({_shifted(sql[i + 6 : comma])}) + {TIE * 10.0**-digits!r}, {digits})")
            at = j
        else:
            out.append(sql[at : i + 6])
            at = i + 6
    return "".join(out) + sql[at:]


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Floats rounded, for comparison by value."""
    chosen = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.select(*[(F.round(F.col(c) + TIE * 10.0**-digits, digits) + 0.0).alias(c) if c in chosen else F.col(c) for c in df.columns])
