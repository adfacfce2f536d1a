"""Column expressions for names, codes and identifiers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_binomial(c: Column) -> Column:
    """The first two adjacent words of plain letters, lower-cased; null where there are none."""
    return F.lower(F.nullif(F.regexp_extract(c, "([A-Za-z]+ [A-Za-z]+)", 1), F.lit("")))


def exactly_two_words(c: Column) -> Column:
    """Whether a name consists of two words separated by white space, no more and no less."""
    return F.size(F.split(F.trim(c), r"\s+")) == 2


def genus(c: Column) -> Column:
    return F.split(c, " ")[0]


def species_caps(c: Column) -> Column:
    """First word capitalised, second in lower case."""
    words = F.split(c, " ")
    return F.concat(F.initcap(words[0]), F.lit(" "), F.lower(words[1]))


def digits_of(c: Column) -> Column:
    """The first run of digits as a number; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")


def base_id(c: Column) -> Column:
    """Text before the first underscore."""
    return F.substring_index(c, "_", 1)


def standard_trait_id(name: str) -> str:
    """``X.X4.`` -> ``X4``; other names stay."""
    import re

    m = re.fullmatch(r"X\.(X\d+)\.?", name)
    return m[1] if m else name


def label_of(c: Column, labels: Mapping) -> Column:
    """Look-up in a fixed dictionary; null for unknown codes."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[c]


def year_of(c: Column) -> Column:
    """Year of an ISO date string; null if it does not start with a number."""
    return F.substring(c, 1, 4).try_cast("smallint")


def classify(c: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the last rule (regular expression, label) that matches: later rules override earlier ones."""
    out = None
    for pattern, label in reversed(list(rules)):
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(default)) if default is not None else out


def two_lines(c: Column, longest: int = 20) -> Column:
    """Long names broken at the first space from the middle on."""
    half = F.floor(F.length(c) / 2).cast("int")
    at = F.instr(F.substr(c, half + 1), F.lit(" ")) + half
    return F.when((F.length(c) > longest) & (at > half), F.overlay(c, F.lit("\n"), at, F.lit(1))).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def nan_to_null(c: Column) -> Column:
    """The one missing value here is null; sources that write NaN pass through this once."""
    return F.when(~F.isnan(c), c)
