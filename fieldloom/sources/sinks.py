"""Writers: tables, reports, nested metadata; overwrites that keep the old data until the new is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] = [], mode: str = "error") -> None:  # noqa: B006
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def safe_overwrite(df: DataFrame, path: str) -> None:
    """Write beside, then swap: the old table stays until the new one is complete."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    P = jvm.org.apache.hadoop.fs.Path
    new, old, at = P(f"{path}.new"), P(f"{path}.old"), P(path)
    fs = at.getFileSystem(conf)
    fs.delete(new, True)
    df.write.parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, at):
        if fs.exists(old):
            fs.rename(old, at)
        raise OSError(f"{path}.new can't take the place of {path}, which is as it was")
    fs.delete(old, True)


def _report_rows(df: DataFrame, most: int) -> list:
    """All rows; a report of more than ``most`` is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small result as a Markdown report."""
    rows = _report_rows(df, most)
    show = lambda v: f"{v:,.3f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]])


def latex(df: DataFrame, most: int = 10_000) -> str:
    """A small result as a LaTeX tabular."""
    rows = _report_rows(df, most)
    esc = lambda v: ("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(esc(v) for v in r) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}"])


def nested_metadata(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, json): {inner: {p2, p98}} of values, for map legends."""
    from fieldloom.operators.stats import linear_quantiles

    per = linear_quantiles(df, [outer, inner], value, {"p2": 0.02, "p98": 0.98})
    return per.groupBy(outer).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), F.struct(F.round("p2", 4).alias("p2"), F.round("p98", 4).alias("p98"))))))).alias("json"))


def parameters_json(params: DataFrame) -> str:
    """A parameter table, one row a trait, as JSON."""
    import json

    return json.dumps({r["trait"]: {k: v for k, v in r.asDict().items() if k != "trait"} for r in params.collect()}, sort_keys=True)


def append_upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> None:
    """Result table by key, the newest row winning."""
    from fieldloom.operators.clean import upsert

    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(conf).exists(at)
    safe_overwrite(upsert(spark.read.parquet(path), new, key) if exists else new, path)
