"""Operator 9, benchmark decontamination by template canonicalisation.

A token is a word without the punctuation around it. Numbers (tokens that begin with a digit, and
number words), units (a unit word right after a number) and names (capitalised inside a sentence) become
typed placeholders, all else lower case; a template window is WINDOW canonical tokens. Windows of the
texts are hash-joined with those of the benchmark. Windows of one text and item at one distance
form an alignment. It counts if its slots are consistent: each value of the item always stands
against the same value of the text, and names that differ, each counted once, make up no more than
1 - SIMILARITY of the tokens it covers. So a question with other numbers or names put in is found; chance
agreement of templates is not, nor are texts that share little but the places of capitals, as in
languages that capitalise nouns. A pair is reported from SIMILARITY of the item's windows on.

A pair that is reported has one of any (1 - SIMILARITY) share of the item's windows and one more, so the
windows of an item that are rarest in the texts choose the pairs to align: a window of placeholders
alone, which many texts have, is only looked at in those.

An item of fewer than WINDOW tokens is one window of all its tokens and is found where they stand as they
are, in any case of letters; as a template it would say nothing.

The hashes of the benchmark go to the tasks if there are at most SET_BOUND; beyond that, all windows
of the texts take part in the join.

Defined cases: null and empty texts and items, and those without tokens, match nothing; equal items are each
reported; rows equal in id and text are reported once; null ids are kept; a very long text is read whole, in
a step of its own; other columns are not read or, by :func:`drop_contaminated`, kept, whatever their names;
empty tables give empty results. Hashes have 64 bits, and windows that agree in hash but differ in
canonical tokens would need a collision.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import Scratch, byte_steps, hash_runs, mix, table, word_sums

WINDOW, SIMILARITY = 5, 0.8
SET_BOUND = 2_000_000
#: Words taken as units after a number, and as numbers, of English, German, French and Spanish. Articles ("one", "ein", "un") are no numbers.
UNITS = """
mm cm m km inch inches in ft feet foot yard yards yd mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz v kv w kw mw j kj kcal cal pa kpa k c f degrees degree percent dollars dollar cents cent euro euros usd eur gbp mph kmh kph meter
meters metre metres gram grams kilogram kilograms kilometer kilometers kilometre kilometres
sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren metern kilometern gramm kilogramm tonnen litern grad prozent meile meilen pfund
seconde secondes heure heures jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes degré degrés pourcent livre livres
segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos toneladas litro litros grado grados milla millas libra libras
"""
NUMBERS = """
two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil
"""
_UNITS, _NUMBERS = frozenset(UNITS.split()), frozenset(NUMBERS.split())
_NUM, _UNIT, _NAME, _BREAK, _EMPTY = 1, 2, 4, 8, 16
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = tuple(".!?:;\"”»)…")


class _Words(dict):
    """Word (bytes) -> index into hashes, flags and values; forgets all when it grows too large."""

    def __init__(self):
        super().__init__()
        self.hashes, self.flags, self.values = [], [], []

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = _STRIP.sub("", text)
        flag = 0
        if word == b"\x01":
            flag = _BREAK | _EMPTY
        elif not core:
            flag = _EMPTY | (_BREAK if text.endswith(_ENDS) else 0)
        else:
            flag = (_NUM if core[0].isdigit() or core.lower() in _NUMBERS else 0) | (_UNIT if core.lower() in _UNITS else 0) | (_NAME if core[0].isupper() and not core[1:].isupper() else 0) | (_BREAK if text.endswith(_ENDS) else 0)
        i = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(core.lower().encode()))
        self.flags.append(flag)
        self.values.append(core)
        return i


def _canonical(words: _Words, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word index, slot type, canonical hash and plain hash of each token."""
    sizes = np.array([len(r) for r in rows], np.int64)
    ids = np.fromiter(map(words.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(rows)), sizes)
    flags, hashes = np.array(words.flags, np.uint8)[ids], np.array(words.hashes, np.uint64)[ids]
    opens = np.ones(len(ids), bool)  # begins a sentence
    opens[1:] = (row[1:] != row[:-1]) | (flags[:-1] & _BREAK > 0)
    real = flags & _EMPTY == 0
    if not real.all():  # what a mark before the token says counts for the token
        group = np.cumsum(real) - real
        broken = np.zeros(len(ids) + 1, bool)
        np.logical_or.at(broken, group, opens)
        opens = broken[group]
    row, ids, flags, hashes, opens = row[real], ids[real], flags[real], hashes[real], opens[real]
    number = flags & _NUM > 0
    after = np.zeros(len(ids), bool)
    after[1:] = number[:-1] & (row[1:] == row[:-1])
    kind = np.where(number, _NUM, np.where((flags & _UNIT > 0) & after, _UNIT, np.where((flags & _NAME > 0) & ~opens, _NAME, 0)))
    return row, ids, kind, np.where(kind > 0, mix(kind.astype(np.uint64)), hashes), hashes


def _windows(known: np.ndarray | None, keep: list[str], short: tuple[int, ...] | None):
    """Windows of WINDOW tokens, and whole short runs: of the lengths ``short``, or, where that is None, the text itself if it is as short."""

    def run(batches):
        words = _Words()
        for batch in batches:
            column = batch.column("text")
            for lo, hi in byte_steps(column, 1 << 21):
                if len(words) > 1_000_000:
                    words = _Words()
                rows = [(t or "").encode("utf-8", "surrogatepass").replace(b"\n", b" \x01 ").split() for t in column.slice(lo, hi - lo).to_pylist()]
                row, ids, kind, hashes, plain = _canonical(words, rows)
                first, sizes = np.searchsorted(row, np.arange(hi - lo)), np.bincount(row, minlength=hi - lo)
                for k in (*(range(1, WINDOW) if short is None else short), WINDOW):
                    n = len(ids) - k + 1
                    at = np.flatnonzero(row[: max(0, n)] == row[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
                    if k < WINDOW and short is None:
                        at = at[sizes[row[at]] == k]
                    w = hash_runs(word_sums(hashes), at, at + k) if k == WINDOW else mix(hash_runs(word_sums(plain), at, at + k) ^ np.uint64(k))
                    if known is not None:
                        near = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                        hit = known[near] == w if len(known) else np.zeros(len(w), bool)
                        at, w = at[hit], w[hit]
                    if len(at):
                        slots = [[f"{kind[j]}{words.values[ids[j]].lower()}" for j in range(i, i + WINDOW) if kind[j]] for i in at.tolist()] if k == WINDOW else [[]] * len(at)
                        r = row[at]
                        take = pa.array(lo + r)
                        yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in keep] + [pa.array((at - first[r]).astype(np.int32)), pa.array(w.view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.array(np.full(len(at), k, np.int32))], [*keep, "at", "w", "slots", "k"])

    return run


def template_windows(df: DataFrame, keep: list[str], known: np.ndarray | None = None, short: tuple[int, ...] | None = None) -> DataFrame:
    """``keep``, at, w, slots, k: canonical windows of the column text, those in ``known`` if given."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["at int, w bigint, slots array<string>, k int"])
    return df.select(*keep, "text").mapInArrow(_windows(known, keep, short), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, bound: int = SET_BOUND) -> DataFrame:
    """(doc_id, th, item_id, n_windows, n_matched, exact): texts that hold an item, as it is (exact) or with other slot values."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.save(template_windows(benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), ["item", "item_id"]), "items")
    hashes = items.select("w").distinct()
    known = np.sort(np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)) if hashes.count() <= bound else None  # checked bound
    short = tuple(sorted(r[0] for r in items.filter(F.col("k") < WINDOW).select("k").distinct().collect()))  # fewer than WINDOW numbers
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    ours = template_windows(texts, ["doc_id", "th"], known, short).drop("k")
    ours = scratch.save(ours if known is not None else ours.join(hashes, "w", "left_semi"), "ours")
    theirs = items.select("item", F.col("at").alias("item_at"), "w", F.col("slots").alias("item_slots"), "k").distinct()
    totals = theirs.groupBy("item").agg(F.countDistinct("item_at").alias("n_windows"))
    # the rarest windows of each item: a row of the benchmark each, ranked within an item
    seen = ours.groupBy("w").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("times", "w", "item_at"))
    ranked = theirs.join(seen, "w").join(totals, "item").withColumn("rank", rank)  # windows that no text has stand before these
    absent = theirs.join(seen, "w", "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("absent"))
    need = F.col("n_windows") - F.ceil(similarity * F.col("n_windows")) + 1
    seeds = ranked.join(absent, "item", "left").filter(F.col("rank") + F.coalesce("absent", F.lit(0)) <= need).select("item", "w").distinct()
    pairs = scratch.save(ours.select("doc_id", "th", "w").join(seeds, "w").select("doc_id", "th", "item").distinct(), "pairs")
    wanted = pairs.join(theirs, "item")  # a row a pair and window of its item
    same = ours["doc_id"].eqNullSafe(wanted["doc_id"]) & (ours["th"] == wanted["th"]) & (ours["w"] == wanted["w"])
    both = ours.join(wanted, same).select(ours["doc_id"], ours["th"], "item", "item_at", "k", (F.col("at") - F.col("item_at")).alias("shift"), F.zip_with("item_slots", "slots", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("pairs"))
    aligned = both.groupBy("doc_id", "th", "item", "shift").agg(F.collect_set("item_at").alias("ats"), F.max("k").alias("k"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    other = F.size(F.filter("pairs", lambda p: (p["x"] != p["y"]) & p["x"].startswith(str(_NAME))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    consistent = aligned.filter((F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"]))) == F.size("pairs")) & (other <= (1 - similarity) * covered + 1e-9))
    exact = F.forall("pairs", lambda p: p["x"] == p["y"])
    per = consistent.select("doc_id", "th", "item", F.explode("ats").alias("at"), exact.alias("exact")).groupBy("doc_id", "th", "item").agg(F.countDistinct("at").alias("n_matched"), F.min("exact").alias("exact"))
    names = items.select("item", "item_id").distinct()
    return per.join(totals, "item").join(names, "item").filter(F.col("n_matched") >= similarity * F.col("n_windows")).select("doc_id", "th", "item_id", "n_windows", "n_matched", "exact")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the share of its windows."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "exact").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item; columns as they came."""
    names = docs.columns
    bad = contaminated(docs, benchmark).select("doc_id", "th").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    return rows.join(bad, rows["_id"].eqNullSafe(bad["doc_id"]) & (rows["_th"] == bad["th"]), "left_anti").select("_row.*")
