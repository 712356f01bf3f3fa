"""Operator 4: language identification by rank-order n-gram profiles.

The profile of a language is the list of its most frequent character n-grams
(one to three letters, a blank marking a word's edge), most frequent first. A
document gets the language whose profile its own profile is least out of place
with: the sum over its n-grams of the difference of ranks, or the largest
difference for n-grams that a language's profile doesn't have.

Profiles are counted over every training document, summed inside partitions
before the shuffle; only ``PROFILE`` n-grams a language reach the driver.

Letters are Unicode's categories L and M, so that marks stay in their words;
every other character is a blank.

Cases: null text, or text without a letter (category L), is ``und`` with score
0; without a single training document every text is ``und``; equal distances go
to the language that sorts first; rows with null lang train nothing; null ids
count as training rows by the crc32 of an empty text; repeated rows are counted and
predicted as often as they appear; ids never leave the JVM; more columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_text, docs, held_out, portable

PROFILE = 400
UNKNOWN = "und"
#: Sharpness of the score: how fast it falls with a rival's mean distance.
SHARPNESS = 40.0
#: N-grams held before a partition's counts are summed, and distinct ones before they are sent on.
HOLD, FLUSH = 4_000_000, 1_000_000

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
BLANK = 32


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers of 21 bits a code point; empty without letters."""
    body = NOT_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    if not LETTER.search(body):
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {body} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != BLANK], two, three[c[1:-1] != BLANK]])


def top(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:size]]


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[np.ndarray]] = {}
    sums: dict[str, dict[str, np.ndarray]] = {}
    waiting = 0

    def fold() -> int:
        total = 0
        for lang, chunks in held.items():
            new, n = np.unique(np.concatenate(chunks), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang]["g"], new])
                new, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([sums[lang]["n"], n])).astype(np.int64)
            sums[lang] = {"g": new, "n": n}
        held.clear()
        for x in sums.values():
            total += len(x["g"])
        return total

    def rows() -> Iterator[pd.DataFrame]:
        for lang, x in sums.items():
            yield pd.DataFrame({"lang": lang, "gram": x["g"], "n": x["n"]})
        sums.clear()

    for part in parts:
        for lang, text in zip(part["lang"], part["text"], strict=True):
            codes = grams(text)
            if len(codes):
                held.setdefault(lang, []).append(codes)
                waiting += len(codes)
                if waiting > HOLD:
                    waiting = 0
                    if fold() > FLUSH:
                        yield from rows()
    if held:
        fold()
    yield from rows()


def train(table: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows of (lang, text): language to its n-grams by rank."""
    counts = table.select("lang", "text").filter("lang is not null and text is not null")
    counts = counts.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= size)
    profiles: dict[str, dict[int, int]] = {}
    for row in best.select("lang", "gram", "rank").collect():
        profiles.setdefault(row["lang"], {})[row["rank"]] = row["gram"]
    return {k: [v[r] for r in sorted(v)] for k, v in sorted(profiles.items())}


def predict(table: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text)."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.asarray(profiles[k], np.int64) for k in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(known) + 1, len(langs)), -1, np.int64)
    for j, k in enumerate(langs):
        ranks[np.searchsorted(known, profiles[k]), j] = np.arange(len(profiles[k]))
    model = table.sparkSession.sparkContext.broadcast((langs, known, ranks))

    def guess(text: str | None) -> tuple[str, float]:
        langs, known, ranks = model.value
        own = top(grams(text), size)
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        theirs = ranks[np.where(known[at] == own, at, len(known))]
        apart = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(own))[:, None]))
        mean = apart.sum(axis=0) / (len(own) * size)
        odds = np.exp(-SHARPNESS * (mean - mean.min()))
        return langs[int(mean.argmin())], float(odds.max() / odds.sum())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([guess(x) for x in part], columns=["lang_pred", "score"])

    asked = by_text(table.select("doc_id", "text"), run, "lang_pred string, score double")
    return asked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_out.lang_pred", "_out.score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = docs(spark, sf_dir).select("doc_id", "lang", "text")
    profiles = train(table.filter(~held_out(F.col("doc_id"))))
    return predict(table, profiles)


portable(__name__)
