"""Configuration as a nested tree with attribute access, from JSON or YAML files that Spark can read, later ones overriding earlier ones."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Config(dict):
    """``config.a.b`` is ``config["a"]["b"]``; a missing name is an AttributeError."""

    def __init__(self, tree: Mapping = {}):  # noqa: B006
        super().__init__({k: Config(v) if isinstance(v, Mapping) else v for k, v in tree.items()})

    def __getattr__(self, name):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def merged(self, other: Mapping) -> Config:
        out = dict(self)
        for k, v in other.items():
            out[k] = Config(out[k]).merged(v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
        return Config(out)


def load_config(spark: SparkSession, *paths: str) -> Config:
    out = Config()
    for p in paths:
        text = spark.read.text(p, wholetext=True).first()[0]
        out = out.merged((_yaml(text) if p.endswith((".yaml", ".yml")) else json.loads(text)) or {})
    return out


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML files need PyYAML; JSON files don't") from e
    return yaml.safe_load(text)


def collect_results(spark: SparkSession, glob: str, pattern: str, names: list[str]) -> DataFrame:
    """CSV results of many folders as one table, with columns ``names`` taken from the path by the groups of ``pattern``."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(glob)
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, i).alias(n) for i, n in enumerate(names, 1)])
