"""Queries: names, filters, outliers, weights, harmonisation, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.operators import assemble, clean
from fieldloom.plans.base import gridded, obs, query, rounded
from fieldloom.sources.readers import table


@query(
    "binomial_clean",
    "SELECT doc_id, lower(nullif(regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1), '')) AS binomial FROM documents WHERE nullif(regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1), '') IS NOT NULL",
)
def binomial_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.first_binomial(F.col("text")).alias("binomial")).dropna(subset=["binomial"])


@query("exact_two_words", "SELECT p_partkey, p_name FROM part WHERE len(regexp_split_to_array(trim(p_name), '\\s+')) = 2")
def exact_two_words(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(names.exactly_two_words(F.col("p_name"))).select("p_partkey", "p_name")


@query(
    "name_parts",
    "SELECT p_partkey, string_split(p_name, ' ')[1] AS genus, upper(p_name[1]) || lower(string_split(p_name, ' ')[1][2:]) || ' ' || lower(string_split(p_name, ' ')[2]) AS caps, nullif(regexp_extract(p_brand, '(\\d+)', 1), '')::INT AS brand_no, CASE p_type WHEN 'ECONOMY' THEN 'e' WHEN 'STANDARD' THEN 's' END AS code FROM part",
)
def name_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", names.genus(F.col("p_name")).alias("genus"), names.species_caps(F.col("p_name")).alias("caps"), names.digits_of(F.col("p_brand")).alias("brand_no"), names.label_of(F.col("p_type"), {"ECONOMY": "e", "STANDARD": "s"}).alias("code"))


@query("trait_ids", "SELECT p_partkey, string_split('X' || p_size || '_mean', '_')[1] AS base, p_size AS number, CASE WHEN p_brand LIKE '%1' THEN 'ones' WHEN p_brand LIKE '%2%' THEN 'twos' ELSE 'other' END AS dataset FROM part")
def trait_ids(spark, sf_dir):
    """Ids of the legacy form taken apart; data sets by the last rule that matches."""
    c = F.concat(F.lit("X"), F.col("p_size").cast("string"), F.lit("_mean"))
    return table(spark, sf_dir, "part").select("p_partkey", names.base_id(c).alias("base"), names.digits_of(c).alias("number"), names.classify(F.col("p_brand"), [("2", "twos"), ("1$", "ones")], "other").alias("dataset"))


@query("iso_year", "SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)::SMALLINT AS yr FROM orders")
def iso_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", names.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("yr"))


@query("clip_scale", "SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_extendedprice, 1000), 30000)::DOUBLE AS v FROM lineitem")
def clip_scale(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", names.clip(F.col("l_extendedprice"), 1000.0, 30000.0).alias("v"))


@query("pft_filter", "WITH {obs} SELECT pft, count(*) AS n FROM obs WHERE pft IN ('ECONOMY', 'STANDARD') GROUP BY pft")
def pft_filter(spark, sf_dir):
    valid = {"ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"}
    return clean.filter_types(obs(spark, sf_dir), "pft", "ECONOMY_STANDARD_NONE", valid).groupBy("pft").agg(F.count(F.lit(1)).alias("n"))


_HOLES = "SELECT p_partkey, nullif(p_size % 3, 0)::DOUBLE AS a, nullif(p_size % 5, 0)::DOUBLE AS b, nullif(p_partkey % 7, 0)::DOUBLE AS c, nullif(p_partkey % 2, 0)::DOUBLE AS d FROM part"


def _holes(spark, sf_dir):
    """Part with nulls put in by expression, as the tables have none."""
    nul = lambda c, m: F.nullif(F.col(c) % m, F.lit(0)).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", nul("p_size", 3).alias("a"), nul("p_size", 5).alias("b"), nul("p_partkey", 7).alias("c"), nul("p_partkey", 2).alias("d"))


@query("dropna_threshold", f"SELECT * FROM ({_HOLES}) WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 3")
def dropna_threshold(spark, sf_dir):
    return clean.drop_sparse(_holes(spark, sf_dir), ["a", "b", "c", "d"], 0.3)


@query("dropna_all_any", f"SELECT p_partkey, a, b, c, d, (a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL) AS whole FROM ({_HOLES}) WHERE coalesce(a, b, c, d) IS NOT NULL")
def dropna_all_any(spark, sf_dir):
    df = _holes(spark, sf_dir).dropna(how="all", subset=["a", "b", "c", "d"])
    return df.withColumn("whole", F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull() & F.col("d").isNotNull())


@query("null_mask", f"SELECT p_partkey, a IS NULL AS a, b IS NULL AS b, c IS NULL AS c, d IS NULL AS d FROM ({_HOLES})")
def null_mask(spark, sf_dir):
    return _holes(spark, sf_dir).select("p_partkey", *[F.col(c).isNull().alias(c) for c in "abcd"])


@query("not_equal_null_safe", f"SELECT * FROM ({_HOLES}) WHERE a IS DISTINCT FROM 1")
def not_equal_null_safe(spark, sf_dir):
    return clean.drop_value(_holes(spark, sf_dir), "a", 1.0)


_B = "b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS el, quantile_cont(l_extendedprice, 0.95) AS eh, quantile_cont(l_quantity, 0.05) AS ql, quantile_cont(l_quantity, 0.95) AS qh FROM lineitem)"


@query("outlier_rows_dropped", f"WITH {_B} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem, b WHERE l_extendedprice BETWEEN el AND eh AND l_quantity BETWEEN ql AND qh")
def outlier_rows_dropped(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return clean.drop_outliers(df, ["l_extendedprice", "l_quantity"], 0.05, 0.95)


@query("outlier_cells_nulled", f"WITH {_B} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice BETWEEN el AND eh THEN l_extendedprice END AS l_extendedprice, CASE WHEN l_quantity BETWEEN ql AND qh THEN l_quantity END AS l_quantity FROM lineitem, b")
def outlier_cells_nulled(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return clean.null_outliers(df, ["l_extendedprice", "l_quantity"], 0.05, 0.95)


@query("min_obs_semi_join", "WITH {obs}, k AS (SELECT species_key FROM obs GROUP BY 1 HAVING count(*) >= 30) SELECT species_key, count(*) AS n, sum(w) AS w FROM obs SEMI JOIN k USING (species_key) GROUP BY 1")
def min_obs_semi_join(spark, sf_dir):
    return clean.min_observations(obs(spark, sf_dir), "species_key", 30).groupBy("species_key").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query(
    "resurvey_year_weight",
    """WITH {obs}, o AS (SELECT plot, species_key, nullif(org, 3) AS org, yr, v FROM obs), k AS (SELECT species_key, org, count(DISTINCT yr) AS n_years FROM o WHERE org IS NOT NULL GROUP BY 1, 2)
SELECT plot, species_key, org::DOUBLE AS org, v, n_years::DOUBLE AS n_years, round(CASE WHEN n_years <= 1 THEN 1 ELSE 1 / n_years END, 6) + 0e0 AS weight FROM o LEFT JOIN k USING (species_key, org)""",
)
def resurvey_year_weight(spark, sf_dir):
    """Weights by the number of years in which an organisation reports a species; a null organisation has none."""
    df = obs(spark, sf_dir).select("plot", "species_key", F.nullif("org", F.lit(3)).alias("org"), "yr", "v")
    return rounded(clean.resurvey_weight(df, ["species_key", "org"], "yr").select("plot", "species_key", F.col("org").cast("double").alias("org"), "v", F.col("n_years").cast("double").alias("n_years"), "weight"), 6, "weight")


@query(
    "resurvey_flag_weight",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'R' THEN 1 / (sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_suppkey) + 1) ELSE 1 END, 8) + 0e0 AS weight FROM lineitem",
)
def resurvey_flag_weight(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag") == "R")
    return rounded(clean.flag_weight(df, ["l_suppkey"], "flag").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "weight"), 8, "weight")


@query(
    "genus_mode_fallback",
    """WITH k AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS g, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS pft FROM part),
c AS (SELECT g, pft, count(*) AS n FROM k WHERE pft IS NOT NULL GROUP BY 1, 2),
m AS (SELECT g, pft AS fill FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS tot, row_number() OVER (PARTITION BY g ORDER BY n DESC, pft) AS r FROM c) WHERE r = 1 AND n / tot >= 0.18)
SELECT p_partkey, p_name, coalesce(pft, fill) AS pft FROM k LEFT JOIN m USING (g)""",
)
def genus_mode_fallback(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("pft"))
    return clean.fill_by_genus(df, "p_name", "pft", 0.18)


@query("harmonise_names", "SELECT p_partkey, p_name, m.brand FROM part LEFT JOIN (SELECT p_name, min(p_brand) AS brand FROM part WHERE p_size > 25 GROUP BY p_name) m USING (p_name)")
def harmonise_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lookup = part.filter("p_size > 25").select("p_name", F.col("p_brand").alias("brand"))
    return clean.harmonise(part.select("p_partkey", "p_name"), lookup, "p_name", "brand")


@query("match_rate", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 10) SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS matched, round(100 * (SELECT count(*) FROM a SEMI JOIN b USING (k)) / (SELECT count(*) FROM a), 4) + 0e0 AS percent")
def match_rate(spark, sf_dir):
    """Distinct keys, those with a partner, and their percentage."""
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct()
    b = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("k"), F.lit(1).alias("m")).distinct()
    out = a.join(b, "k", "left").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("matched"))
    return rounded(out.withColumn("percent", 100 * F.col("matched") / F.col("n")), 4)


_CELLS = """m AS (SELECT "row" AS y, "col" AS x, CASE source WHEN 'F' THEN 's' ELSE 'g' END AS source, pft, avg(v) AS v, count(*) AS n FROM obs GROUP BY 1, 2, 3, 4)"""


def _cells(spark, sf_dir):
    src = F.when(F.col("source") == "F", "s").otherwise("g")
    return gridded(spark, sf_dir).groupBy(F.col("row").alias("y"), F.col("col").alias("x"), src.alias("source"), "pft").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))


@query("source_priority_dedup", "WITH {obs}, " + _CELLS + " SELECT x, y, source, round(v, 4) + 0e0 AS v, n FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY source DESC) AS r FROM m WHERE pft = 'ECONOMY') WHERE r = 1")
def source_priority_dedup(spark, sf_dir):
    df = _cells(spark, sf_dir).filter("pft = 'ECONOMY'").select("x", "y", "source", "v", "n")
    return rounded(clean.filter_trait_set(df, "sg"), 4, "v")


@query("union_sources", "WITH {obs}, " + _CELLS + " SELECT x, y, source, round(v, 4) + 0e0 AS v, n, CASE WHEN source = 's' THEN pft END AS pft FROM m")
def union_sources(spark, sf_dir):
    """Union by name; columns that a source lacks are null."""
    m = _cells(spark, sf_dir)
    return rounded(m.filter("source = 's'").unionByName(m.filter("source = 'g'").drop("pft"), allowMissingColumns=True).select("x", "y", "source", "v", "n", "pft"), 4, "v")


_PFTS = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]


@query("outer_merge_traits", "WITH {obs}, " + _CELLS + " SELECT x, y, source, " + ", ".join(f"round(max(v) FILTER (pft = '{p}'), 4) + 0e0 AS {p.lower()}" for p in _PFTS) + " FROM m GROUP BY 1, 2, 3")
def outer_merge_traits(spark, sf_dir):
    """N-way full outer join by one aggregation."""
    wide = assemble.outer_wide(_cells(spark, sf_dir), ["x", "y", "source"], "pft", "v", _PFTS)
    return rounded(wide.withColumnsRenamed({p: p.lower() for p in _PFTS}))


@query("upsert_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 5 = 0)::INT DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    """New rows (every fifth order) replace old ones of the same customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return clean.upsert(o.filter("o_orderkey % 5 <> 0"), o.filter("o_orderkey % 5 = 0"), ["o_custkey"])


@query("anti_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_missing(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return clean.missing(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("set_operations", "SELECT 'both' AS k, count(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity = 1) UNION ALL SELECT 'first only', count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity = 1)")
def set_operations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = li.filter("l_quantity = 50").select("l_suppkey"), li.filter("l_quantity = 1").select("l_suppkey")
    count = lambda df, k: df.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "first only"))


@query("validated_join", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def validated_join(spark, sf_dir):
    """1:1 join with both keys checked."""
    return clean.unique_join(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"], "1:1").select("doc_id", "source", "quality", "toxic")


@query("reliability_weights", "WITH {obs}, " + _CELLS + ", e AS (SELECT min(sqrt(n)) AS lo, max(sqrt(n)) AS hi FROM m) SELECT x, y, source, pft, round(0.1e0 + (sqrt(n) - lo) / (hi - lo) * 0.9e0, 6) + 0e0 AS reliability FROM m, e")
def reliability_weights(spark, sf_dir):
    return rounded(clean.reliability(_cells(spark, sf_dir), "n").select("x", "y", "source", "pft", "reliability"), 6)


@query("source_weights", "WITH {obs}, " + _CELLS + ", e AS (SELECT count(*) FILTER (source = 's') AS s, count(*) AS a FROM m) SELECT x, y, source, pft, round(CASE WHEN source = 's' THEN 1 ELSE s / a END, 6) + 0e0 AS weight FROM m, e")
def source_weights(spark, sf_dir):
    return rounded(clean.source_weights(_cells(spark, sf_dir)).select("x", "y", "source", "pft", "weight"), 6)


@query("exact_holdout", "WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus = 'F' AND r <= floor(n * 0.1) AS is_test FROM o")
def exact_holdout(spark, sf_dir):
    """Exactly a tenth of one source, in key order so that SQL can follow."""
    return clean.holdout(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", 0.1, F.col("o_orderkey")).select("o_orderkey", "is_test")


@query("hash_holdout", "WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ('0x' || substr(md5(concat_ws(':', o_orderkey, '42')), 1, 15))::BIGINT) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus = 'F' AND r <= floor(n * 0.1) AS is_test FROM o")
def hash_holdout(spark, sf_dir):
    """The same with a seeded order."""
    from fieldloom.operators.stats import shuffled

    return clean.holdout(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", 0.1, shuffled("o_orderkey")).select("o_orderkey", "is_test")


@query("nested_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def nested_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
