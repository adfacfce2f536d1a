"""Scans: tables by format, nested archives, spreadsheets, rasters, look-ups, catalogues."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_any(spark: SparkSession, path: str, schema: str | None = None, columns: Iterable[str] | None = None, **options) -> DataFrame:
    """Reader by suffix: .parquet, .csv, .csv.gz, .tsv, .txt, .json, .orc; ``columns`` prune the scan."""
    name = PurePosixPath(path).name.lower().removesuffix(".gz")
    kind = PurePosixPath(name).suffix
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    if kind in (".csv", ".tsv", ".txt"):
        df = reader.option("header", options.get("header", True)).option("sep", options.get("sep", "," if kind == ".csv" else "\t")).csv(path)
    elif kind in (".parquet", ""):
        df = reader.parquet(path)
    elif kind == ".json":
        df = reader.json(path)
    elif kind == ".orc":
        df = reader.orc(path)
    else:
        raise ValueError(f"no reader for {path!r}")
    return df.select(*columns) if columns else df


def read_zipped_csv(spark: SparkSession, path: str, members: list[str], schema: str, encoding: str = "latin-1", columns: list[str] | None = None) -> DataFrame:
    """A CSV inside nested zip archives: ``members`` name the way down. Archives are opened on executors, one a task."""
    names = [f.strip().rsplit(" ", 1)[0].strip("`") for f in schema.split(",")]

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                data = bytes(content)
                for m in members:
                    data = zipfile.ZipFile(io.BytesIO(data)).read(m)
                yield pd.read_csv(io.BytesIO(data), encoding=encoding, usecols=names)[names]

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)
    return out.select(*columns) if columns else out


def read_excel(spark: SparkSession, path: str, sheet: str, required: list[str]) -> DataFrame:
    """A sheet, with required columns checked; a driver-side read, as such files are small."""
    import pandas as pd

    pdf = pd.read_excel(path, sheet_name=sheet)
    if absent := set(required) - set(pdf.columns):
        raise ValueError(f"columns missing: {sorted(absent)}")
    return spark.createDataFrame(pdf[required])


def na_strings_to_null(df: DataFrame, marks: tuple[str, ...] = ("NA", "NaN", "")) -> DataFrame:
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[F.when(~F.col(c).isin(*marks), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def read_raster_cells(spark: SparkSession, path: str, decode, schema: str = "row int, col int, band string, value double") -> DataFrame:
    """Raster files as long cell tables: ``decode(bytes) -> iterator of pandas frames`` runs on executors, one file a task."""

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield from decode(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def ascii_grid(data: bytes):
    """Decoder of ESRI ASCII grids."""
    import numpy as np
    import pandas as pd

    lines = data.decode().splitlines()
    head = {k.lower(): float(v) for k, v in (x.split() for x in lines[:6])}
    values = np.array([x.split() for x in lines[6:] if x.strip()], float)
    row, col = np.indices(values.shape)
    keep = values.ravel() != head["nodata_value"]
    yield pd.DataFrame({"row": row.ravel()[keep].astype("int32"), "col": col.ravel()[keep].astype("int32"), "band": "1", "value": values.ravel()[keep]})


def stack_rasters(parts: dict[str, DataFrame]) -> DataFrame:
    """Aligned rasters as one wide table, in one shuffle."""
    from fieldloom.operators.assemble import outer_wide, union_long

    return outer_wide(union_long(parts, "band"), ["row", "col"], "band", "value", list(parts))


def raster_metadata(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, min, max, missing): what a metadata scan of bands reports."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(F.col(value).isNull()).alias("missing"))


def read_lookup(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object as a dictionary, for fixed look-ups of names and units."""
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def trait_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(trait, description) from ``- X4 # text`` lines of a configuration file."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^\s*-\s*(X\d+)\s*#\s*(.+?)\s*$", 1).alias("trait"), F.regexp_extract("value", r"^\s*-\s*(X\d+)\s*#\s*(.+?)\s*$", 2).alias("description")).filter("trait <> ''")


def read_folds(spark: SparkSession, glob: str, pattern: str = r"fold_(\d+)") -> DataFrame:
    """CSV files of folds with the fold number from the path."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(glob)
    return df.withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int"))


def list_names(spark: SparkSession, glob: str) -> list[str]:
    """Names of the files and folders that match."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(str(x.getPath().getName()) for x in fs.globStatus(path) or [])


def latest_run(names: Iterable[str]) -> str | None:
    """The newest ``run_YYYYMMDD_HHMMSS``."""
    return max((n for n in names if re.fullmatch(r"run_\d{8}_\d{6}", n)), default=None)
