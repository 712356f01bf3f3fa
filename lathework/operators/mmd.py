"""Maximum mean discrepancy between two tables, in one pass over their rows.

A kernel is written as a product of features: a linear or cubic one exactly (by monomials), a
Gaussian one by random Fourier features, whose spread gives the statistic's error. The
discrepancy is the squared distance of the tables' mean features, so that no pair of rows is
formed. Permutations are re-labellings by a hash of the row's id, each row falling to
the reference with its share; their sums are taken in the same pass. Tasks emit sums as wide as
the features, a row a permutation, which are added up in two steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
FREQUENCIES, PERMUTATIONS, MEDIAN_ROWS, MAX_FEATURES = 128, 100, 500, 4096
SALTS = 32


def frequencies(dims: int, count: int, gamma: float, seed: int = 0) -> np.ndarray:
    """Frequencies of exp(-gamma * squared distance)."""
    return np.random.default_rng(seed).normal(size=(count, dims)) * (2 * gamma) ** 0.5


def multipliers(count: int, seed: int = 0) -> np.ndarray:
    """(a, b) of each permutation's hash (a * h + b) mod PRIME."""
    return np.random.default_rng((seed, 1)).integers(1, PRIME, (count, 2))


def cubic(dims: int) -> list[tuple[tuple[int, ...], float]]:
    """Monomials of (1 + x.y)^3: which of (1, x...) are multiplied, and the root of how often."""
    out = []
    for own in combinations_with_replacement(range(dims + 1), 3):
        out.append((own, (6 / prod(factorial(own.count(i)) for i in set(own))) ** 0.5))
    return out


def median_gamma(reference: DataFrame, key: str, features: Sequence[str], seed: int = 0) -> float:
    """1 / the median squared distance, over the ``MEDIAN_ROWS`` rows with the least md5 of seed and id."""
    some = reference.select(key, *features).dropna().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))).limit(MEDIAN_ROWS)
    x = np.array([[float(v) for v in r[1:]] for r in some.collect()]).reshape(-1, len(features))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    return 1 / float(np.median(d[d > 0])) if (d > 0).any() else 1.0


def mmd(reference: DataFrame, current: DataFrame, key: str, features: Sequence[str], kernel: str = "rbf", gamma: float | None = None, count: int = FREQUENCIES, permutations: int = PERMUTATIONS, threshold: float = 0.05, seed: int = 0) -> DataFrame:
    """One row: statistic, error (of its approximation; 0 for exact kernels), p_value, is_drift,
    n_reference and n_current. ``kernel`` is rbf, linear or polynomial; without ``gamma``, rbf takes the
    median heuristic. Rows with a null or NaN feature or a null id are left out; with an empty
    side all but the counts is null."""
    spark, dims = reference.sparkSession, len(features)
    if kernel == "rbf":
        w = frequencies(dims, count, median_gamma(reference, key, features, seed) if gamma is None else gamma, seed)
    elif kernel not in ("linear", "polynomial"):
        raise ValueError(f"unknown kernel {kernel}")
    terms = cubic(dims) if kernel == "polynomial" else []
    if len(terms) > MAX_FEATURES:
        raise ValueError("too many features for this kernel")

    def mapped(x: np.ndarray) -> np.ndarray:
        if kernel == "linear":
            return x
        if kernel == "rbf":
            turns = x @ w.T
            return np.concatenate([np.cos(turns), np.sin(turns)], axis=1) / count**0.5
        one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        return np.stack([root * one[:, own].prod(axis=1) for own, root in [(list(o), r) for o, r in terms]], axis=1)

    value = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    hashed = (F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % PRIME).alias("h")
    sides = [df.filter(F.col(key).isNotNull()).select(F.lit(side).alias("ref"), hashed, *[v.alias(f"_f{i}") for i, v in enumerate(value)]).dropna() for df, side in ((reference, True), (current, False))]
    rows = sides[0].unionByName(sides[1]).select("ref", "h", F.array(*[f"_f{i}" for i in range(dims)]).alias("x"))
    sizes = {r["ref"]: r["n"] for r in rows.groupBy("ref").agg(F.count("*").alias("n")).collect()}
    n_ref, n_cur = sizes.get(True, 0), sizes.get(False, 0)
    schema = "statistic double, error double, p_value double, is_drift boolean, n_reference long, n_current long"
    if not n_ref or not n_cur:
        return spark.createDataFrame([(None, None, None, None, n_ref, n_cur)], schema)
    share, hashes = n_ref / (n_ref + n_cur), multipliers(permutations, seed)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0, 0
        for part in parts:
            if len(part):
                mapped_rows = mapped(np.stack(part["x"].to_numpy()))
                drawn = (part["h"].to_numpy()[:, None] * hashes[None, :, 0] + hashes[None, :, 1]) % PRIME < share * PRIME
                marks = np.concatenate([np.ones((len(part), 1)), part["ref"].to_numpy()[:, None], drawn], axis=1).astype(float)
                total, n = total + marks.T @ mapped_rows, n + marks.sum(axis=0)
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"draw": range(len(n)), "n": n, "s": list(total), "salt": int(hash(tuple(total[0])) % SALTS)})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"draw": part["draw"].iloc[:1], "n": [part["n"].sum()], "s": [np.sum(np.stack(part["s"].to_numpy()), axis=0)]})

    taken = rows.mapInPandas(sums, "draw int, n double, s array<double>, salt int")
    merged = taken.groupBy("draw", "salt").applyInPandas(add, "draw int, n double, s array<double>").groupBy("draw").applyInPandas(add, "draw int, n double, s array<double>")
    found = {r["draw"]: (r["n"], np.array(r["s"])) for r in merged.collect()}  # permutations x features
    n, total = found[0]

    def gaps(draw: int) -> np.ndarray:
        k, s = found[draw]
        return (s / max(k, 1) - (total - s) / max(n - k, 1)) ** 2

    own = gaps(1)
    statistic = float(own.sum())
    error = float(np.std((own[:count] + own[count:]) * count) / count**0.5) if kernel == "rbf" else 0.0
    p = float(np.mean([gaps(i + 2).sum() >= statistic for i in range(permutations)])) if permutations else None
    return spark.createDataFrame([(statistic, error, p, p is not None and p < threshold, n_ref, n_cur)], schema)
