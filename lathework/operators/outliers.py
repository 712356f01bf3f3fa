"""Outliers of whole rows: isolation forests, robust ellipses and density against
neighbours.

All give the rows of ``df`` with ``outlier_score``, higher for stranger rows, null where a
feature is null or NaN. ``act`` then flags, removes or imputes the strangest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import quantiles

SCORE = "outlier_score"


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


# isolation forest


def average_path(n: int) -> float:
    """The mean depth at which a search of ``n`` values fails in a random tree."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Tree:
    """Nodes in order of growth: feature and cut of a split with its two children, the left
    below the cut; a leaf has feature -1 and holds the depth that a row ends with."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    depth: list[float]


def grow(values: Sequence[Sequence[float]], seed: str) -> Tree:
    """A tree of random cuts of ``values``, as deep as the logarithm of their number. A node draws one of
    the features that differ in it and a cut between its ends from the md5 of the seed and the node."""
    from hashlib import md5
    from math import ceil, log2

    import numpy as np

    x = np.asarray(values, dtype=float)
    tree, limit = Tree([], [], [], [], []), ceil(log2(max(2, len(x))))

    def add(rows, level: int) -> int:
        at = len(tree.feature)
        for part, v in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.depth, level + average_path(len(rows)))):
            part.append(v)
        wide = [f for f in range(x.shape[1]) if len(rows) and rows[:, f].min() < rows[:, f].max()]
        if level >= limit or not wide:
            return at
        digest = md5(f"{seed}:{at}".encode()).hexdigest()
        f = wide[int(digest[:8], 16) % len(wide)]
        low, high = rows[:, f].min(), rows[:, f].max()
        split = low + (high - low) * ((int(digest[8:16], 16) + 0.5) / 2**32)
        below = rows[:, f] < split
        tree.feature[at], tree.cut[at] = f, float(split)
        tree.left[at] = add(rows[below], level + 1)
        tree.right[at] = add(rows[~below], level + 1)
        return at

    add(x, 0)
    return tree


@dataclass(frozen=True)
class Forest:
    """Trees, each grown from ``rows`` rows."""

    features: list[str]
    trees: list[Tree]
    rows: int

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with 2 to the power of minus the mean depth over the expected one. Batches walk all
        trees at once in numpy; what goes with a task is the trees, of a size that ``fit`` bounds."""
        trees, usual = self.trees, average_path(self.rows) or 1.0

        @F.pandas_udf("double")
        def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            import numpy as np

            nodes = [(np.array(t.feature), np.array(t.cut), np.array(t.left), np.array(t.right), np.array(t.depth)) for t in trees]
            for part in parts:
                x = part.to_numpy(dtype=float)
                every, deep = np.arange(len(x)), np.zeros(len(x))
                for feature, split, left, right, depth in nodes:
                    at = np.zeros(len(x), dtype=int)
                    while (inner := feature[at] >= 0).any():
                        who = every[inner]
                        f = feature[at[who]]
                        at[who] = np.where(x[who, f] < split[at[who]], left[at[who]], right[at[who]])
                    deep += depth[at]
                out = pd.Series(np.power(2.0, -deep / len(nodes) / usual))
                yield out.mask(np.isnan(x).any(axis=1))

        return df.withColumn(SCORE, walk(F.struct(*[_number(f).alias(f"_x{i}") for i, f in enumerate(self.features)])))


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 100, rows: int = 256, seed: int = 0) -> Forest:
    """A forest grown from ``trees`` times ``rows`` rows at most, those least by the md5 of seed and key:
    the sample that the method is defined by, with a size that doesn't depend on the table's. Every row is then
    scored. Rows with a null or NaN feature aren't drawn; small tables share their rows among trees."""
    known = df.select(F.col(key).cast("string").alias("_k"), *[_number(f).alias(f"_x{i}") for i, f in enumerate(features)]).dropna()
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), "_k").cast("binary"))
    drawn = known.withColumn("_p", place).orderBy("_p", *[f"_x{i}" for i in range(len(features))]).limit(trees * rows).collect()
    points = [[r[f"_x{i}"] for i in range(len(features))] for r in drawn]
    if not points:
        return Forest(list(features), [Tree([-1], [0.0], [-1], [-1], [0.0])], 2)
    size = min(rows, len(points))
    parts = [[points[(t * size + j) % len(points)] for j in range(size)] for t in range(trees)]
    return Forest(list(features), [grow(p, f"{seed}:{t}") for t, p in enumerate(parts)], size)


# robust ellipse


@dataclass(frozen=True)
class Ellipse:
    """A centre and the inverse of a covariance."""

    features: list[str]
    centre: list[float]
    inverse: list[list[float]]

    def _squared(self) -> Column:
        gap = [_number(f) - c for f, c in zip(self.features, self.centre, strict=True)]
        return _total([gap[i] * gap[j] * self.inverse[i][j] for i in range(len(gap)) for j in range(len(gap))])

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with the squared Mahalanobis distance to the centre."""
        return df.withColumn(SCORE, self._squared())


def _ellipse(df: DataFrame, features: Sequence[str], around: Sequence[float]) -> Ellipse | None:
    """Mean and covariance (by n) of ``df``, from one aggregate of products of distances to
    ``around``, so that digits aren't lost far from 0."""
    import numpy as np

    k = len(features)
    gap = [_number(f) - a for f, a in zip(features, around, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(F.count("*").alias("n"), *[F.avg(g).alias(f"m{i}") for i, g in enumerate(gap)], *[F.avg(gap[i] * gap[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not row["n"]:
        return None
    m = np.array([row[f"m{i}"] for i in range(k)])
    c = np.zeros((k, k))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] - m[i] * m[j]
    return Ellipse(list(features), [float(a + x) for a, x in zip(around, m, strict=True)], np.linalg.pinv(c, hermitian=True).tolist())


def elliptic_envelope(df: DataFrame, features: Sequence[str], support: float = 0.5, steps: int = 10) -> Ellipse:
    """The ellipse of the ``support`` share of rows that lie closest together: from medians and median
    distances to them on, rows up to the exact ``support`` quantile of the distance (ties included) give the
    next centre and covariance, until they stay or ``steps`` are done. At last the
    covariance is scaled so that the median distance is the chi-squared one.

    A step is a quantile and an aggregate of all rows; only the matrix, as wide as the features, is on the driver."""
    import numpy as np

    rows = cut(df.select(*[_number(f).alias(f) for f in features]).dropna())
    mid = [quantiles(rows, f, [0.5]).first()[0][0] for f in features]
    if any(m is None for m in mid):
        raise ValueError("no row has all features")
    far = [quantiles(rows, F.abs(F.col(f) - m), [0.5]).first()[0][0] for f, m in zip(features, mid, strict=True)]
    found = Ellipse(list(features), mid, np.diag([1 / d**2 if d else 1.0 for d in far]).tolist())
    last = None
    for _ in range(steps):
        edge = quantiles(rows, found._squared(), [support]).first()[0][0]
        new = _ellipse(rows.filter(found._squared() <= edge), features, found.centre)
        if new is None or new == last:
            break
        last = found = new
    middle = quantiles(rows, found._squared(), [0.5]).first()[0][0]
    k = len(features)
    usual = _chi_squared_median(k)
    scale = usual / middle if middle else 1.0
    return Ellipse(found.features, found.centre, (np.asarray(found.inverse) * scale).tolist())


def _chi_squared_median(k: int) -> float:
    """The median of a chi-squared variable, by halving on the regularised gamma series."""
    from math import exp, lgamma

    def below(x: float) -> float:
        h, a = x / 2, k / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return total * exp(-h + a * log(h) - lgamma(a))

    low, high = 1e-9, 2.0 * k
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < 0.5 else (low, mid)
    return low


# what to do with them


def act(scored: DataFrame, features: Sequence[str], contamination: float, action: str = "flag", flag: str = "is_outlier") -> DataFrame:
    """Rows with a score above the exact 1 - ``contamination`` quantile: ``flag`` adds a 0/1 column, ``remove``
    drops them, ``impute`` puts medians of all rows in place of their features. Rows without score are none."""
    if action not in ("flag", "remove", "impute"):
        raise ValueError(f"no action {action}")
    edge = quantiles(scored, SCORE, [1 - contamination], out="_edge")
    rows = scored.crossJoin(F.broadcast(edge))  # one row
    hit = F.coalesce(F.col(SCORE) > F.get("_edge", F.lit(0)), F.lit(False))
    if action == "flag":
        return rows.withColumn(flag, hit.cast("int")).drop("_edge", SCORE)
    if action == "remove":
        return rows.filter(~hit).drop("_edge", SCORE)
    rows = rows.withColumn("_hit", hit)
    for i, f in enumerate(features):
        rows = rows.crossJoin(F.broadcast(quantiles(scored, f, [0.5], out=f"_q{i}")))  # one row
    rows = rows.withColumns({f: F.when(F.col("_hit"), F.get(f"_q{i}", F.lit(0))).otherwise(F.col(f)) for i, f in enumerate(features)})
    return rows.drop("_edge", "_hit", SCORE, *[f"_q{i}" for i in range(len(features))])
