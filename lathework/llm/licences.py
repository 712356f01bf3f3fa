"""Operator 6: licence scans by a trained paragraph classifier.

Paragraphs are lines; a notice may run over several of them, up to a blank one.
Runs of words that hold enough of the n-grams (one to three words) of a notice
are looked for across lines; a softmax regression over sparse n-grams names the
licence family of a run or ``unknown``, so that a line may name several. What no
run takes of a line is judged as a whole. The regression is trained in numpy on variations of the notices below (words dropped, doubled or
replaced, foreign words around them) and, for the unknown class, on a sample of
the corpus' own paragraphs: at most ``2 * BACKGROUND``, taken by a hash of id,
number and text, with all n-grams of a paragraph and its first ``HEAD`` words.
The probability that a family needs is calibrated on all paragraphs of the
corpus, whose scores Spark counts: the least one, in steps of 1 / ``STEPS`` of
log odds, at which no more than ``FALSE_SHARE`` of the unknown paragraphs (those
with less than half of any notice) pass. A prediction counts if the text judged
also holds enough of the n-grams of one of the family's notices. A notice of at most
``SHORT`` words counts only where it begins or ends a line. A notice is
reported with the line it begins in.

Cases: null and empty texts have no paragraphs and an empty list of families;
a paragraph has no greatest length; repeated rows and rows without id are
judged like any other (ids never leave the JVM); an empty table gives an empty
result; more columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, docs, portable

#: Usual wordings of licence notices.
NOTICES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license"],
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the bsd 3 clause license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1 0", "creative commons zero cc0 1 0 universal public domain dedication"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "proprietary": ["all rights reserved", "proprietary and confidential unauthorized copying is strictly prohibited"],
}
UNKNOWN = "unknown"
VARIATIONS, BACKGROUND = 60, 4_000
EPOCHS, RATE, RIDGE = 200, 0.5, 1e-4
FALSE_SHARE, CONTAINED = 0.001, 0.6
#: A notice of so few words must begin or end a line, as prose may hold them by chance.
SHORT = 3
#: A paragraph with this share of a notice isn't taken as unknown.
PLAIN = 0.5
#: Words of a sampled paragraph that reach the driver, taken at even steps over
#: all of it (by their first 40 letters, as no notice has a word that long); steps of a unit of log odds, and the most steps.
HEAD, STEPS, TOP = 20, 100, 3000

TOKENS = re.compile(r"[^\W_]+")


def tokens(paragraph: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in TOKENS.findall(paragraph.lower())]


def ngrams(words: list[str], vocabulary=None) -> set[str]:
    """Word n-grams of one to three; with a vocabulary, only those in it (all of
    whose words it has, so that other words break a run)."""
    out = set()
    for i, w in enumerate(words):
        if vocabulary is not None and w not in vocabulary:
            continue
        for n in range(1, 4):
            g = " ".join(words[i : i + n])
            if i + n <= len(words) and (vocabulary is None or g in vocabulary):
                out.add(g)
    return out


class Classifier:
    def __init__(self, vocabulary: list[str], families: list[str], weights: np.ndarray, least: float) -> None:
        self.at = {g: i for i, g in enumerate(vocabulary)}
        self.families, self.weights, self.least = families, weights, least
        #: family number, n-grams and greatest length of a run, by notice
        self.notices = [(k, ngrams(tokens(t)), 2 * len(tokens(t)) + 4) for k, f in enumerate(families[:-1]) for t in NOTICES[f]]

    def probabilities(self, grams: set[str]) -> np.ndarray:
        z = self.weights[[self.at[g] for g in sorted(grams)]].sum(axis=0) + self.weights[-1]
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, grams: set[str]) -> tuple[str, float]:
        """The family, or unknown, of n-grams of the vocabulary and its probability."""
        if not grams:
            return UNKNOWN, 1.0
        p = self.probabilities(grams)
        k = int(p.argmax())
        if k == len(self.families) - 1 or p[k] < self.least:
            return UNKNOWN, float(p[-1])
        held = max(len(grams & own) / len(own) for at, own, _ in self.notices if at == k)
        return (self.families[k], float(p[k])) if held >= CONTAINED else (UNKNOWN, float(p[-1]))

    def holds(self, grams: set[str]) -> float:
        """The largest share of a notice's n-grams."""
        return max(len(grams & own) / len(own) for _, own, _ in self.notices)

    def step(self, paragraph: str) -> int | None:
        """The step of log odds of a paragraph's best family, -1 under 0, None if
        the paragraph isn't taken as unknown."""
        grams = ngrams(tokens(paragraph), self.at)
        if self.holds(grams) >= PLAIN:
            return None
        best = float(self.probabilities(grams)[:-1].max()) if grams else 0.0
        if best < 0.5:
            return -1
        return TOP if best >= 1 else min(TOP, int(np.log(best / (1 - best)) * STEPS))

    def runs(self, words: list[str], own: set[str], longest: int) -> list[tuple[float, int, int]]:
        """(share, start, end) of the runs that hold enough of a notice's n-grams,
        each the shortest one from its start; the best of those that overlap."""
        ends = [[(n, g) for n in range(1, 4) if n <= e + 1 and (g := " ".join(words[e - n + 1 : e + 1])) in own] if w in own else [] for e, w in enumerate(words)]
        found = []
        for s in range(len(words)):
            if not ends[s]:
                continue
            held, end = set(), s
            for e in range(s, min(s + longest, len(words))):
                more = {g for n, g in ends[e] if e - n + 1 >= s} - held
                if more:
                    held |= more
                    end = e
            if len(held) >= CONTAINED * len(own):
                found.append((len(held) / len(own), s, end + 1))
        return apart(sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])))

    def block(self, lines: list[list[str]]) -> list[tuple[int, str, float]]:
        """(line, family, probability) of the notices in lines of words without a
        blank one between them."""
        words = [w for line in lines for w in line]
        grams = ngrams(words, self.at)
        hold = [x for x in self.notices if len(grams & x[1]) >= CONTAINED * len(x[1])]
        if not hold:
            return []
        found, inside = [], []
        starts = [0, *accumulate(map(len, lines))]
        edges = set(starts)
        for k, own, longest in hold:
            for share, s, e in self.runs(words, own, longest):
                if longest <= 2 * SHORT + 4 and s not in edges and e not in edges:
                    inside.append((s, e))
                    continue
                family, p = self.judge(ngrams(words[s:e], self.at))
                if family == self.families[k]:
                    found.append((share * p, s, e, family, p))
        taken = apart(sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])))
        left = list(words)
        for s, e in [*(x[1:3] for x in taken), *inside]:
            left[s:e] = [""] * (e - s)
        out = [(bisect_right(starts, s) - 1, family, p) for _, s, _, family, p in taken]
        for i, (at, end) in enumerate(pairwise(starts)):
            family, p = self.judge(ngrams(left[at:end], self.at))
            if family != UNKNOWN:
                out.append((i, family, p))
        best = {}
        for i, family, p in out:
            best[i, family] = max(p, best.get((i, family), 0.0))
        return [(i, family, p) for (i, family), p in sorted(best.items())]

    def document(self, text: str | None) -> tuple[int, list[tuple[int, str, float]]]:
        """The number of paragraphs, and number, family and probability of notices."""
        n, found, lines = 0, [], []
        for line in [*(text or "").split("\n"), ""]:
            if line.strip():
                lines.append(tokens(line))
            elif lines:
                found += [(n + i, family, p) for i, family, p in self.block(lines)]
                n, lines = n + len(lines), []
        return n, found


def apart(found: list[tuple]) -> list[tuple]:
    """Of (_, start, end, ...), the first ones that don't overlap."""
    out, used = [], set()
    for x in found:
        if used.isdisjoint(range(x[1], x[2])):
            used.update(range(x[1], x[2]))
            out.append(x)
    return out


def vary(words: list[str], noise: list[str], rng) -> list[str]:
    """A variation of a notice: up to a tenth of its words changed, noise around it."""
    out = []
    for w in words:
        roll = rng.random()
        out += [] if roll < 0.03 else [w, w] if roll < 0.05 else [noise[rng.integers(len(noise))]] if roll < 0.08 else [w]
    pick = lambda: [noise[i] for i in rng.integers(len(noise), size=rng.integers(0, 8))]
    return pick() + out + pick()


def vocabulary() -> list[str]:
    return sorted(set().union(*(ngrams(tokens(t)) for ts in NOTICES.values() for t in ts)))


def train(own: list[tuple[list[int], list[str]]]) -> Classifier:
    """From the notices and (n-grams, words) of unknown paragraphs; lets all pass."""
    rng = np.random.default_rng(6)
    families, words = [*sorted(NOTICES), UNKNOWN], vocabulary()
    at = {g: i for i, g in enumerate(words)}
    own = own or [([at["0"]], ["0"])]
    noise = sorted({x for _, head in own for x in head}) or ["0"]
    rows = [(vary(tokens(t), noise, rng), k) for k, f in enumerate(families[:-1]) for t in NOTICES[f] for _ in range(VARIATIONS)]
    # unknown too: plain paragraphs, and scattered words of the notices among them
    stock = sorted({x for ts in NOTICES.values() for t in ts for x in tokens(t)})
    rows += [([*w[:10], *(stock[i] for i in rng.integers(len(stock), size=3)), *w[10:]], len(families) - 1) for _, w in own[: len(own) // 2]]
    found = [sorted(at[g] for g in ngrams(w, at)) for w, _ in rows] + [sorted(g) for g, _ in own]
    y = np.array([k for _, k in rows] + [len(families) - 1] * len(own))
    idx = np.concatenate([np.asarray(f, np.int64) for f in found])
    row = np.repeat(np.arange(len(y)), [len(f) for f in found])
    weights, balance = np.zeros((len(words) + 1, len(families))), 1 / np.maximum(1, np.bincount(y, minlength=len(families)))[y]
    balance /= balance.sum()

    def predict(w: np.ndarray) -> np.ndarray:
        z = np.stack([np.bincount(row, weights=w[idx, k], minlength=len(y)) for k in range(len(families))], axis=1) + w[-1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, EPOCHS + 1):
        g = predict(weights)
        g[np.arange(len(y)), y] -= 1
        g *= balance[:, None]
        grad = np.stack([np.bincount(idx, weights=g[row, k], minlength=len(words)) for k in range(len(families))], axis=1)
        grad = np.vstack([grad, g.sum(axis=0)]) + RIDGE * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights = weights - RATE * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(words, families, weights, 0.0)


def background(table: DataFrame) -> list[tuple[list[int], list[str]]]:
    """(n-grams, words at even steps) of a sample of the unknown paragraphs."""
    lines = table.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "p")).filter(F.col("p").rlike(r"\S"))
    lines = lines.select("p", F.pmod(F.xxhash64(F.lit("licence"), "doc_id", "at", "p"), F.lit(1 << 40)).alias("h"))
    share = min(1.0, 2 * BACKGROUND / max(1, lines.count()))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary()
        model = Classifier(words, [*sorted(NOTICES), UNKNOWN], np.zeros((len(words) + 1, len(NOTICES) + 1)), 0.0)
        for batch in batches:
            out = []
            for p, h in zip(batch["p"], batch["h"], strict=True):
                own = tokens(p)
                grams = ngrams(own, model.at)
                if own and model.holds(grams) < PLAIN:
                    out.append((h, sorted(model.at[g] for g in grams), [w[:40] for w in ([own[i * len(own) // HEAD] for i in range(HEAD)] if len(own) > HEAD else own)]))
            yield pd.DataFrame(out, columns=["h", "grams", "head"])

    few = lines.filter(F.col("h") < int(share * (1 << 40))).mapInPandas(digest, "h long, grams array<int>, head array<string>")
    return [(r["grams"], r["head"]) for r in few.orderBy("h", "grams", "head").limit(2 * BACKGROUND).collect()]


def calibrate(table: DataFrame, model: Classifier) -> float:
    """The least probability that no more than ``FALSE_SHARE`` of all unknown
    paragraphs reach, 0.5 at least."""
    parts = table.sparkSession.sparkContext.broadcast((sorted(model.at, key=model.at.get), model.families, model.weights, model.least))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Classifier(*parts.value)
        for batch in batches:
            steps = Counter(model.step(p) for text in batch["text"] for p in (text or "").split("\n") if p.strip())
            steps.pop(None, None)
            yield pd.DataFrame(sorted(steps.items()), columns=["step", "n"])

    steps = {r["step"]: r["n"] for r in table.select("text").mapInPandas(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()}
    allowed, passed = int(sum(steps.values()) * FALSE_SHARE), 0
    for step in sorted((x for x in steps if x >= 0), reverse=True):
        passed += steps[step]
        if passed > allowed:
            return float("inf") if step == TOP else float(1 / (1 + np.exp(-(step + 1) / STEPS)))
    return 0.5


def scan(table: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, families, paragraphs): the families found, sorted,
    and the numbers, families and probabilities of the paragraphs they are in."""
    model = train(background(table))
    model.least = calibrate(table, model)
    parts = table.sparkSession.sparkContext.broadcast((sorted(model.at, key=model.at.get), model.families, model.weights, model.least))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(*parts.value)
        for batch in batches:
            out = []
            for text in batch:
                n, found = model.document(text)
                out.append((n, sorted({x[1] for x in found}), [{"paragraph": i, "family": f, "score": s} for i, f, s in found]))
            yield pd.DataFrame(out, columns=["n_paragraphs", "families", "paragraphs"])

    found = by_text(table.select("doc_id", "text"), run, "n_paragraphs long, families array<string>, paragraphs array<struct<paragraph: int, family: string, score: double>>")
    return found.select("doc_id", "_out.*")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(docs(spark, sf_dir))
    return found.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), F.array_max("paragraphs.score").alias("score"))


portable(__name__)
