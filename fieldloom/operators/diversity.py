"""Functional diversity of plots: Simpson, Rao, pairwise dissimilarity, evenness, richness, redundancy."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.stats import join_keys


def proportions(df: DataFrame, plot: str, species: str, abundance: str, traits: list[str]) -> DataFrame:
    """(plot, species, p, traits): one row a species and plot, abundances summed and normalised."""
    rows = df.groupBy(plot, species).agg(F.sum(abundance).alias("_a"), *[F.min(t).alias(t) for t in traits])
    totals = rows.groupBy(plot).agg(F.sum("_a").alias("_t"))
    return rows.join(totals, plot).select(plot, species, (F.col("_a") / F.col("_t")).alias("p"), *traits)


def simpson(p: DataFrame, plot: str) -> DataFrame:
    return p.groupBy(plot).agg((1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))


def rao(p: DataFrame, plot: str, species: str, traits: list[str]) -> DataFrame:
    """Sum over species pairs of p_i p_j d_ij. Pairs arise within one plot, whose species are few by nature."""
    a, b = p.select(plot, F.struct(species, "p", *traits).alias("a")), p.select(plot, F.struct(species, "p", *traits).alias("b"))
    d = F.sqrt(sum((F.pow(F.col(f"a.{t}") - F.col(f"b.{t}"), 2) for t in traits), F.lit(0.0)))
    pairs = a.join(b, plot).filter(F.col(f"a.{species}") < F.col(f"b.{species}"))
    return pairs.groupBy(plot).agg(F.sum(F.col("a.p") * F.col("b.p") * d).alias("rao"))


def dissimilarity(p: DataFrame, plot: str, species: str, traits: list[str]) -> DataFrame:
    """(plot, simpson, rao, mpd = f_div, f_red = 1 - f_div); mpd is null where Simpson's index is 0."""
    s, q = simpson(p, plot), rao(p, plot, species, traits)
    out = join_keys(s, q, [plot]).select(plot, "simpson", F.coalesce("rao", F.lit(0.0)).alias("rao"))
    out = out.withColumn("mpd", F.when(F.col("simpson") > 1e-12, F.col("rao") / F.col("simpson")))
    return out.withColumn("f_red", 1 - F.col("mpd"))


def spanning_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of a minimum spanning tree of points, by Prim's method."""
    n = len(x)
    best, link, inside, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = (d < best) & ~inside
        best[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((int(link[at]), at, float(best[at])))
    return out


def evenness(x: np.ndarray, p: np.ndarray) -> float | None:
    """Functional evenness over all edges of the spanning tree; null under three species."""
    n = len(x)
    if n < 3:
        return None
    ew = np.array([d / (p[i] + p[j]) for i, j, d in spanning_tree(x)])
    if ew.sum() <= 0:
        return None
    share, least = ew / ew.sum(), 1 / (n - 1)
    return float((np.minimum(share, least).sum() - least) / (1 - least))


def hull_volume(x: np.ndarray) -> float | None:
    """Volume of the convex hull; null for fewer than three points or than dimensions + 1, and for flat sets."""
    x = np.unique(np.asarray(x, float), axis=0)
    n, d = x.shape
    if n < 3 or n <= d:
        return None
    if d == 1:
        return float(np.ptp(x))
    if d == 2:
        pts = sorted(map(tuple, x))

        def half(points):
            out = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        ring = np.array(half(pts) + half(pts[::-1]))
        area = abs(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))) / 2
        return float(area) if area > 0 else None
    # facets of an incremental hull: each new point outside replaces the facets that it sees
    centre_ids = None
    for ids in itertools.combinations(range(n), d + 1):
        if abs(np.linalg.det(x[list(ids[1:])] - x[ids[0]])) > 1e-12:
            centre_ids = ids
            break
    if centre_ids is None:
        return None
    centre = x[list(centre_ids)].mean(0)

    def plane(face):
        base = x[list(face)]
        normal = np.linalg.svd(base[1:] - base[0])[2][-1]
        offset = normal @ base[0]
        return (normal, offset) if normal @ centre < offset else (-normal, -offset)

    faces = {frozenset(f): plane(f) for f in itertools.combinations(centre_ids, d)}
    for i in set(range(n)) - set(centre_ids):
        seen = [f for f, (a, b) in faces.items() if a @ x[i] > b + 1e-12]
        ridges: dict[frozenset, int] = {}
        for f in seen:
            for r in itertools.combinations(sorted(f), d - 1):
                ridges[frozenset(r)] = ridges.get(frozenset(r), 0) + 1
            del faces[f]
        for r, k in ridges.items():
            if k == 1:
                face = frozenset({*r, i})
                faces[face] = plane(sorted(face))
    fact = np.prod(range(1, d + 1))
    return float(sum(abs(np.linalg.det(x[sorted(f)] - centre)) for f in faces) / fact)


def gated_diversity(df: DataFrame, plot: str, species: str, abundance: str, traits: list[str], least: float, n_min: int, n_max: int) -> DataFrame:
    """Diversity of plots whose rows number n_min to n_max and whose abundances sum up to ``least``."""
    fit = df.groupBy(plot).agg(F.count(F.lit(1)).alias("_n"), F.sum(abundance).alias("_s")).filter(F.col("_n").between(n_min, n_max) & (F.col("_s") >= least)).select(plot)
    return dissimilarity(proportions(df.join(fit, plot, "left_semi"), plot, species, abundance, traits), plot, species, traits)


def functional_diversity(df: DataFrame, plot: str, species: str, abundance: str, traits: list[str], n_min: int = 2) -> DataFrame:
    """sp_ric, f_ric, f_eve of each plot: a spanning tree and a hull need the plot's species together, which are few by nature."""
    p = proportions(df, plot, species, abundance, traits)

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf["rows"]:
                x, own = np.array([r["x"] for r in rec], float).reshape(len(rec), len(traits)), np.array([r["p"] for r in rec], float)
                rows.append((len(rec), None, None) if len(rec) < n_min else (len(rec), hull_volume(x), evenness(x, own)))
            out = pd.DataFrame(rows, columns=["sp_ric", "f_ric", "f_eve"])
            out.insert(0, plot, pdf[plot].to_numpy())
            yield out

    whole = p.dropna(subset=traits).groupBy(plot).agg(F.array_sort(F.collect_list(F.struct(F.col(species).alias("s"), "p", F.array(*[F.col(t).cast("double") for t in traits]).alias("x")))).alias("rows"))
    return whole.mapInPandas(run, f"{plot} {df.schema[plot].dataType.simpleString()}, sp_ric int, f_ric double, f_eve double")


def fd_metrics(df: DataFrame, plot: str, species: str, abundance: str | None, traits: list[str]) -> DataFrame:
    """(plot, sp_ric, f_ric, f_eve, f_div, f_red) of each plot in one row; without an abundance, rows of a species count."""
    rows = df.withColumn("_one", F.lit(1.0)) if abundance is None else df
    own = abundance or "_one"
    shape = functional_diversity(rows, plot, species, own, traits)
    spread = dissimilarity(proportions(rows, plot, species, own, traits), plot, species, traits)
    return join_keys(shape, spread.select(plot, F.col("mpd").alias("f_div"), "f_red"), [plot])
