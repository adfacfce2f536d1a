"""Operator 6, license scans [native]: MinHash bands over overlapping windows, then shingle containment.

Texts are lower-cased and cut into words of letters, digits and dots; a shingle is five words.
A template of m shingles belongs to the class of windows of S shingles, S the power of two not
below m; windows of a class have 2 S shingles and start every S, so that any passage of a template's
length lies whole in one. A band is one MinHash value (the least of BANDS seeded hashes over the
shingles). Containment of 0.8 means a Jaccard similarity of at least 0.19 with that window, and
0.81 ** 64 < 2e-6 of such windows share no band with the template.

A window can only share a band if it has the very shingle that is the template's least under that
band's hash. So shingles are first looked up in the set of those leasts, a hash-set test on the
scan; band values are computed for the windows around hits alone, and give what they would give
over all windows. Every candidate is then verified by exact containment of the template's shingles.

Whole licence texts are templates in passages of about PASSAGE words, so that a text with only the later
conditions or the warranty clause is found too; passages overlap so that each shingle lies in one.
A phrase under five words is one shingle of all its words, looked up exactly by :func:`scan_phrases`.

Defined cases: null, empty and short texts match nothing; ``scan`` refuses a template under five words,
``scan_phrases`` one of five or more, and both an empty one; repeated rows report the same
matches each; a very long text is cut into windows inside its row, and only windows around hits leave it;
other columns are not read, whatever their names; an empty table of texts or of templates gives an empty
result. Equal matches in overlapping windows are one row, at the first.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, let, table

SHINGLE, BANDS, CONTAINED, PASSAGE = 5, 64, 0.8, 60
#: Shingles of templates up to which the look-up is a literal set in the plan; beyond, it is a join.
SET_BOUND = 20_000

#: Wordings of public licences, as notices and opening paragraphs give them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Wordings under five words, for :func:`scan_phrases`.
PHRASES = {"All rights reserved": "All rights reserved."}


def passages(name: str, text: str) -> dict[str, str]:
    """Parts of about PASSAGE words of a whole text, each with the first SHINGLE - 1 words of the next."""
    words = [w for w in text.split() if any(c.isalnum() for c in w)]
    n = max(1, round(len(words) / PASSAGE))
    cuts = [len(words) * i // n for i in range(n + 1)]
    return {f"{name} part {i + 1}": " ".join(words[cuts[i] : cuts[i + 1] + SHINGLE - 1]) for i in range(n)}


for _file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
    TEMPLATES |= passages(_file.stem, _file.read_text(encoding="utf-8"))


def license_words(text: Column) -> Column:
    """Lower-case words; what is not a letter, digit or dot separates, and dots at a word's end go."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\.(?=[^\p{L}\p{N}]|$)", " "), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)])))
        return F.when(F.size(w) >= SHINGLE, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(words, of)


def _band(h: Column, band: Column) -> Column:
    return F.xxhash64(h, band)


def _signature(shingles: Column) -> Column:
    """For each band the (value, shingle) that is least over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.struct(_band(h, b).alias("value"), h.alias("h")))).alias("least")))


def template_table(templates: DataFrame) -> DataFrame:
    """(template, shingles, m, size) of rows (template, text); ``size`` is the window class."""
    rows = templates.select("template", F.array_distinct(_shingles(license_words(F.col("text")))).alias("shingles")).withColumn("m", F.size("shingles"))
    return rows.withColumn("size", F.expr("cast(pow(2, ceil(log2(m))) as int)"))


def scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, template, first_shingle, containment): windows of each text that hold at least ``contained`` of a template's shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = scratch.save(template_table(templates), "templates")
    if not known.filter("m < 1 OR template IS NULL").isEmpty():
        raise ValueError(f"a template needs a name and {SHINGLE} words")
    bands = known.select("template", "size", F.explode(_signature(F.col("shingles"))).alias("s")).select("template", "size", "s.band", F.col("s.least.value").alias("value"), F.col("s.least.h").alias("h"))
    bands = scratch.save(bands, "bands")
    leasts = bands.select("h").distinct()
    rows = docs.select("doc_id", _shingles(license_words(F.col("text"))).alias("shingles")).withColumn("row", F.monotonically_increasing_id())
    few = leasts.count() <= SET_BOUND
    if few:
        by_size = {r["size"]: sorted(r["hs"]) for r in bands.groupBy("size").agg(F.collect_set("h").alias("hs")).collect()}  # at most SET_BOUND numbers, and as many again for a shingle in several classes
        starts = _starts(by_size)
        windows = rows.select("row", "doc_id", "shingles", let(_hits(by_size), starts).alias("at"))
    else:  # shingles travel one by one; a text's own places come back to it as one list
        rows = scratch.save(rows, "rows")
        places = rows.select("row", F.posexplode("shingles").alias("i", "h")).join(bands.select("h", "size").distinct(), "h")
        places = places.select("row", "size", F.explode(F.expr("array_distinct(array(greatest(0, i div size - 1), i div size))")).alias("at")).distinct()
        windows = rows.join(places.groupBy("row").agg(F.collect_list(F.struct("size", "at")).alias("at")), "row").select("row", "doc_id", "shingles", "at")
    cut = F.transform("at", lambda x: F.struct(x["size"].alias("size"), (x["at"] * x["size"]).alias("start"), F.slice("shingles", x["at"] * x["size"] + 1, 2 * x["size"]).alias("window")))
    windows = scratch.save(windows.filter(F.size("at") > 0).select("row", "doc_id", F.explode(cut).alias("x")).select("row", "doc_id", "x.*"), "windows")
    pick = F.broadcast if few else (lambda x: x)
    signed = windows.select("row", "size", "start", F.explode(_signature(F.col("window"))).alias("s")).select("row", "size", "start", "s.band", F.col("s.least.value").alias("value"))
    candidates = signed.join(pick(bands.select("template", "size", "band", "value")), ["size", "band", "value"]).select("row", "size", "start", "template").distinct()
    share = F.size(F.array_intersect("window", "shingles")) / F.col("m")
    both = windows.join(candidates, ["row", "size", "start"])
    verified = both.join(pick(known.select("template", "shingles", "m")), "template").withColumn("containment", share).filter(F.col("containment") >= contained)
    first = F.array_min(F.filter(F.transform("window", lambda x, i: F.when(F.array_contains(F.col("shingles"), x), F.col("start") + i)), lambda x: x.isNotNull()))
    return verified.select("row", "doc_id", "template", first.alias("first_shingle"), "containment").groupBy("row", "doc_id", "template", "first_shingle").agg(F.max("containment").alias("containment")).drop("row")


def _hits(by_size: dict[int, list[int]]) -> Column:
    """(h, i) of the shingles that are any template's least."""
    wanted = sorted({h for hs in by_size.values() for h in hs})
    return F.filter(F.transform("shingles", lambda x, i: F.when(x.isin(wanted), F.struct(x.alias("h"), i.alias("i")))), lambda x: x.isNotNull())


def _starts(by_size: dict[int, list[int]]):
    """Of hits, the (size, at) of the windows around them, each once."""

    def of_size(hits: Column, size: int, hs: list[int]) -> Column:
        own = F.filter(hits, lambda x: x["h"].isin(hs))
        at = F.flatten(F.transform(own, lambda x: F.array(F.greatest(F.lit(0), F.floor(x["i"] / size) - 1).cast("int"), F.floor(x["i"] / size).cast("int"))))
        return F.transform(F.array_distinct(at), lambda a: F.struct(F.lit(size).alias("size"), a.alias("at")))

    def of(hits: Column) -> Column:
        parts = [of_size(hits, size, hs) for size, hs in sorted(by_size.items())]
        return F.flatten(F.array(*parts)) if parts else F.expr("cast(array() as array<struct<size: int, at: int>>)")

    return of


def scan_phrases(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, template, first_shingle, containment): each place of a phrase under five words, by its words; containment is 1."""
    known = Scratch(docs.sparkSession).save(templates.select("template", license_words(F.col("text")).alias("own")).select("template", F.size("own").alias("k"), F.concat_ws(" ", "own").alias("phrase"), F.get("own", F.lit(0)).alias("first")), "phrases")
    if not known.filter(f"template IS NULL OR k < 1 OR k >= {SHINGLE}").isEmpty():
        raise ValueError(f"a phrase needs a name and one to {SHINGLE - 1} words")
    lengths = sorted(r[0] for r in known.select("k").distinct().collect())  # at most SHINGLE - 1 numbers
    firsts = known.select("first").distinct()
    few = firsts.count() <= SET_BOUND
    wanted = [r[0] for r in firsts.collect()] if few else []  # at most SET_BOUND words

    def places(w: Column) -> Column:
        def of(k: int) -> Column:
            at = lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.concat_ws(" ", F.slice(w, i + 1, k)).alias("phrase"))
            return F.transform(w, lambda x, i: F.when(x.isin(wanted), at(i)) if few else at(i))

        return F.filter(F.flatten(F.array(*[of(k) for k in lengths])), lambda x: x.isNotNull())

    if not lengths:
        return docs.select("doc_id", F.lit("").alias("template"), F.lit(0).alias("first_shingle"), F.lit(1.0).alias("containment")).limit(0)
    found = docs.select("doc_id", F.explode(let(license_words(F.col("text")), places)).alias("x")).select("doc_id", "x.*")
    own = known.select("template", "k", "phrase")
    return found.join(F.broadcast(own) if few else own, ["k", "phrase"]).select("doc_id", "template", F.col("i").alias("first_shingle"), F.lit(1.0).alias("containment"))


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence wordings in all documents."""
    return scan(table(spark, sf_dir, "documents"), built_in(spark)).withColumn("containment", F.round("containment", 6))


def op6_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases under five words in all documents."""
    return scan_phrases(table(spark, sf_dir, "documents"), spark.createDataFrame(list(PHRASES.items()), "template string, text string"))


def _sql() -> str:
    """Containment in every window of each class, without bands: words joined by spaces stand for shingles."""
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '\.([^\p{L}\p{N}]|$)', ' \1', 'g'), '[^\p{L}\p{N}.]+'), lambda x: x <> '')"
    shingles = f"list_transform(range(1, greatest(1, len(w) - {SHINGLE - 2})), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))"
    return f"""
WITH t0 AS (SELECT template, list_distinct({shingles}) AS ts FROM (SELECT template, {words} AS w FROM (VALUES {rows}) v(template, text))),
t AS (SELECT template, ts, len(ts) AS m, (2 ** ceil(log2(len(ts))))::INT AS size FROM t0),
d AS (SELECT r, doc_id, {shingles} AS s FROM (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents)),
p AS (SELECT r, doc_id, unnest(s) AS h, unnest(range(0, len(s))) AS i FROM d),
ts AS (SELECT template, size, m, unnest(ts) AS h FROM t),
q AS (SELECT r, doc_id, template, size, m, h, i, unnest(CASE WHEN i // size > 0 THEN [i // size - 1, i // size] ELSE [0] END) AS win FROM p JOIN ts USING (h)),
c AS (SELECT r, doc_id, template, win, count(DISTINCT h) / any_value(m) AS containment, min(i) AS first_shingle FROM q GROUP BY r, doc_id, template, win)
SELECT doc_id, template, first_shingle::INT AS first_shingle, round(max(containment), 6) AS containment FROM c WHERE containment >= {CONTAINED}
GROUP BY r, doc_id, template, first_shingle
"""


SQL = _sql()


def _phrases_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in PHRASES.items())
    words = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '\.([^\p{L}\p{N}]|$)', ' \1', 'g'), '[^\p{L}\p{N}.]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT template, {words} AS own FROM (VALUES {rows}) v(template, text)), d AS (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)
SELECT doc_id, template, i::INT AS first_shingle, 1e0 AS containment FROM p JOIN t ON w[i + 1 : i + len(own)] = own
"""


PHRASES_SQL = _phrases_sql()
