"""Wide and long tables: outer assembly of many sources, pivots, unpivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_long(parts: dict[str, DataFrame], name: str = "trait", value: str = "value") -> DataFrame:
    """Tables (keys, value) of several traits as one long table."""
    rows = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r, allowMissingColumns=True)
    return whole


def outer_wide(long: DataFrame, keys: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """N-way full outer join on ``keys`` by one aggregation: one shuffle for all columns, however many."""
    return long.groupBy(*keys).agg(*[F.first(F.when(F.col(name) == c, F.col(value)), ignorenulls=True).alias(c) for c in columns])


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def pivot_stats(df: DataFrame, by: list[str], name: str, columns: list[str], stats: dict[str, Column]) -> DataFrame:
    """Columns ``{stat}_{column}``; missing cells are null."""
    out = df.groupBy(*by).pivot(name, columns).agg(*[c.alias(s) for s, c in stats.items()])
    if len(stats) == 1:
        s = next(iter(stats))
        return out.withColumnsRenamed({c: f"{s}_{c}" for c in columns})
    return out.withColumnsRenamed({f"{c}_{s}": f"{s}_{c}" for c in columns for s in stats})


def align(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` in order, cast, missing ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])
