"""Operator 7, quality rules [native]: weak supervision in place of all-must-pass filtering.

Nine rules vote good (1) or bad (-1) or abstain (0) on each document. There are at most 3**9 vote
patterns, whatever the corpus: the counts of patterns are all that estimation needs. Expectation-
maximisation over them fits a mixture of good documents and of one kind of bad ones per family of
defects (FAMILIES): per kind its share, and how often each rule that doesn't abstain votes bad on it.
A bad document need not show all defects, so one bad kind for all would take whichever rules vote
together for the only defect. The posterior of good of a document's pattern decides: a bad vote of a
rule that the corpus shows to hit good documents too rejects nothing, two rules that agree do.
No estimate is bounded; a count of ADDED on either side keeps rates from 0 and 1.
Estimation runs inside one ``aggregate`` expression over the (bounded) array of patterns.

Defined cases: a null text has no words; documents without words fail the base rule; rules that
need words abstain without them; a very long text is measured whole, inside one row; repeated rows are
judged alike, each counted; equal posteriors give equal verdicts; an empty table gives an empty result.
Extra columns are kept by :func:`filter_quality`, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, let, table, words_of

WINDOW = 5
ROUNDS = 40
#: Start of estimation: share of good documents, and how often a rule votes bad on good documents, on its own family's kind, on other bad kinds.
PRIOR, BAD_OF_GOOD, BAD_OF_OWN, BAD_OF_OTHER = 0.8, 0.05, 0.7, 0.1
#: Counts added to each rate, for and against, and to each share.
ADDED = 1.0
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A word with two marks in a row, or of marks alone.
MARKED = r"[^\p{L}\p{M}\p{N}]{2}|\A[^\p{L}\p{M}\p{N}]+\z"


def _repeat_words(w: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the text has twice or more."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def count(hashes: Column) -> Column:
        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            where = F.array_sort(F.transform(twice, lambda x: x["i"]))
            first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
            return F.aggregate(where, first, step, lambda a: a["n"])

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), covered))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, count))


def measures(text: Column) -> Column:
    """A struct of what the rules look at; window equality is by 64-bit hash within one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.char_length(F.array_join(w, "")).alias("word_chars"),
        F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).alias("n_caps"), F.size(F.filter(w, lambda x: x.rlike(MARKED))).alias("n_marked"), F.size(F.array_distinct(w)).alias("n_distinct"),
    ))
    # a text without any of the symbols is settled by byte search, far below the price of a regular expression
    some = lambda symbols: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in symbols])
    count = lambda symbols, name: F.when(some(symbols), F.regexp_count(t, F.lit(f"[{symbols}]"))).otherwise(0).cast("long").alias(name)
    return F.struct(by_words.alias("w"), by_lines.alias("l"), count("#*$%&|<>", "n_symbols"), count("!", "n_exclaim"))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    m = docs.select(*keep, measures(F.col("text")).alias("_m"))
    return m.select(*keep, *[F.col(f"_m.{p}").cast("long").alias(n) for p, n in (("w.n_words", "n_words"), ("w.word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("l.n_dup_lines", "n_dup_lines"), ("w.n_repeat_words", "n_repeat_words"), ("l.n_lines", "n_lines"), ("w.n_caps", "n_caps"), ("w.n_marked", "n_marked"), ("w.n_distinct", "n_distinct"), ("n_exclaim", "n_exclaim"))])


#: Rule -> (bad if, good if), of measures; neither: it abstains.
RULES = {
    "length": ("n_words < 25", "n_words >= 50"),
    "word_length": ("n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 9 * n_words)", "n_words > 0 AND word_chars >= 4 * n_words AND word_chars <= 8 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "n_words > 0 AND 50 * n_symbols <= n_words"),
    "marks": ("10 * n_marked > n_words", "n_words > 0 AND 50 * n_marked <= n_words"),
    "lines": ("n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines", "n_lines > 1 AND n_dup_lines = 0"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "n_words > 0 AND 100 * n_repeat_words <= 5 * n_words"),
    "distinct": ("2 * n_distinct < n_words", "3 * n_distinct > 2 * n_words"),
    "case": ("2 * n_caps > n_words", "n_words > 0 AND 5 * n_caps < n_words"),
    "exclaim": ("5 * n_exclaim > n_words", "n_words > 0 AND 20 * n_exclaim <= n_words"),
}
#: Kinds of bad documents, each by the rules that see it. The rules in none are weak ones, which estimation weighs.
FAMILIES = {"glyphs": ("symbols", "marks"), "repetition": ("lines", "repeats", "distinct"), "shouting": ("case", "exclaim")}
KINDS = 1 + len(FAMILIES)
K = len(RULES)
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def votes() -> Column:
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for bad, good in RULES.values()])


def starting_rates() -> list[list[float]]:
    """Of each kind, good first, the rate at which each rule votes bad."""
    return [[BAD_OF_GOOD] * K] + [[BAD_OF_OWN if name in family else BAD_OF_OTHER for name in RULES] for family in FAMILIES.values()]


def starting_shares() -> list[float]:
    return [PRIOR] + [(1 - PRIOR) / len(FAMILIES)] * len(FAMILIES)


def _shares_of(v: Column, s: Column) -> Column:
    """Posterior of each kind, of votes ``v`` under estimates ``s``."""

    def log_of(c: int) -> Column:
        out = F.log(F.get(s["share"], c))
        for j in range(K):
            rate, x = F.get(F.get(s["bad"], c), j), F.get(v, j)
            out = out + F.when(x == -1, F.log(rate)).when(x == 1, F.log(1 - rate)).otherwise(F.lit(0.0))
        return out

    def normal(logs: Column) -> Column:
        likely = lambda most: F.transform(logs, lambda x: F.exp(x - most))
        return let(let(F.array_max(logs), likely), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y)))

    return let(F.array(*[log_of(c) for c in range(KINDS)]), normal)


def estimate(patterns: Column, rounds: int = ROUNDS) -> Column:
    """(share[kind], bad[kind][rule]) by expectation-maximisation over an array of (v, n)."""
    start = F.struct(F.array(*[F.lit(x) for x in starting_shares()]).alias("share"), F.array(*[F.array(*[F.lit(x) for x in row]) for row in starting_rates()]).alias("bad"))

    def turn(s: Column, _: Column) -> Column:
        def weigh(p: Column) -> Column:
            return F.struct(p["v"].alias("v"), F.transform(_shares_of(p["v"], s), lambda x: x * p["n"]).alias("w"))

        def rates(q: Column) -> Column:
            total = lambda c, which: F.aggregate(q, F.lit(0.0), lambda acc, p: acc + F.when(which(p["v"]), F.get(p["w"], c)).otherwise(F.lit(0.0)))
            rate = lambda c, j: (total(c, lambda v: F.get(v, j) == -1) + ADDED) / (total(c, lambda v: F.get(v, j) != 0) + 2 * ADDED)
            sums = F.array(*[total(c, lambda v: F.lit(True)) + ADDED for c in range(KINDS)])
            share = let(sums, lambda t: F.transform(t, lambda x: x / F.aggregate(t, F.lit(0.0), lambda a, y: a + y)))
            return F.struct(share.alias("share"), F.array(*[F.array(*[rate(c, j) for j in range(K)]) for c in range(KINDS)]).alias("bad"))

        return let(F.transform(patterns, weigh), rates)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn)


def estimates(voted: DataFrame) -> DataFrame:
    """One row (patterns, s): the vote patterns that occur, 3**K at most, and what estimation says of them."""
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counted.agg(F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("patterns")).withColumn("s", estimate(F.col("patterns")))


def posteriors(voted: DataFrame) -> DataFrame:
    """(votes, posterior) of each pattern that occurs, 3**K rows at most."""
    return estimates(voted).select(F.explode("patterns").alias("p"), "s").select(F.col("p.v").alias("votes"), F.get(_shares_of(F.col("p.v"), F.col("s")), F.lit(0)).alias("posterior"))


def judge(voted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds base_failed, posterior and kept to rows with measures and votes, which are read twice."""
    known = F.broadcast(posteriors(voted))  # at most 3**K rows, for any corpus
    return voted.join(known, "votes").withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, votes, posterior and verdict of every document."""
    m = Scratch(spark).save(measured(table(spark, sf_dir, "documents"), "doc_id").withColumn("votes", votes()), "measures")
    return judge(m).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"), F.round("posterior", 6).alias("posterior"))


def filter_quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected ones, all columns as they came. Rows are written once beside their votes, so that texts are measured once."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    m = measured(rows, "_row").select("_row", votes().alias("votes"), F.expr(BASE_FAILED).alias("base"))
    m = Scratch(docs.sparkSession).save(m, "voted")
    known = F.broadcast(posteriors(m))  # at most 3**K rows
    return m.join(known, "votes").filter(~F.col("base") & (F.col("posterior") >= threshold)).select("_row.*")


def _sql() -> str:
    """The same measures, votes and estimation, with one pair of common table expressions a round."""
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    cast = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (bad, good) in enumerate(RULES.values()))
    vs = ", ".join(f"v{j}" for j in range(K))
    log_of = lambda c: f"ln(p{c})" + "".join(f" + CASE v{j} WHEN -1 THEN ln(r{c}_{j}) WHEN 1 THEN ln(1 - r{c}_{j}) ELSE 0 END" for j in range(K))
    logs, kinds = ", ".join(f"{log_of(c)} AS l{c}" for c in range(KINDS)), range(KINDS)
    most, total = "greatest(" + ", ".join(f"l{c}" for c in kinds) + ")", " + ".join(f"e{c}" for c in kinds)
    shares = lambda state: f"SELECT *, {', '.join(f'e{c} / ({total}) AS g{c}' for c in kinds)} FROM (SELECT *, {', '.join(f'exp(l{c} - {most}) AS e{c}' for c in kinds)} FROM (SELECT p.*, {logs} FROM p, {state}))"
    part = lambda c, which: f"coalesce(sum(n * g{c}) FILTER ({which}), 0)"
    fresh = ", ".join(f"({part(c, f'v{j} = -1')} + {ADDED}e0) / ({part(c, f'v{j} <> 0')} + {2 * ADDED}e0) AS r{c}_{j}" for c in kinds for j in range(K))
    share = ", ".join(f"(sum(n * g{c}) + {ADDED}e0) / (sum(n) + {KINDS * ADDED}e0) AS p{c}" for c in kinds)
    start = ", ".join([f"{x}e0 AS p{c}" for c, x in enumerate(starting_shares())] + [f"{x}e0 AS r{c}_{j}" for c, row in enumerate(starting_rates()) for j, x in enumerate(row)])
    rounds = ", ".join(f"g{i} AS MATERIALIZED ({shares(f's{i - 1}')}), s{i} AS MATERIALIZED (SELECT {share}, {fresh} FROM g{i})" for i in range(1, ROUNDS + 1))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {words} AS w FROM documents),
h AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
x AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM h), range(0, {WINDOW}) z(o) WHERE c > 1 GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda y: y = upper(y) AND y <> lower(y))) AS n_caps, len(regexp_extract_all(t, '!')) AS n_exclaim,
        len(list_filter(w, lambda y: regexp_matches(y, '{MARKED}'))) AS n_marked, len(list_distinct(w)) AS n_distinct
      FROM d JOIN l USING (r) LEFT JOIN x USING (r)),
q AS (SELECT *, {cast} FROM m),
p AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM q GROUP BY ALL),
s0 AS MATERIALIZED (SELECT {start}), {rounds},
y AS (SELECT *, g0 AS posterior FROM ({shares(f's{ROUNDS}')}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND posterior >= {THRESHOLD}e0 AS kept,
       concat_ws(',', {vs}) AS votes, round(posterior, 6) AS posterior
FROM q JOIN y USING ({vs})
"""


SQL = _sql()
