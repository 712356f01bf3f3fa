from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """(id, text, lang, source) rows as a documents table with columns whose
    names the operators also use."""

    def make(rows, extra: bool = True):
        full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("score", "piece", "size", "spans", "held_out", "w", "row", "_out", "_lw_row", "_lw_group", "_n"):
                df = df.selectExpr("*", f"'clash' as {name}")
        return df

    return make


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 97} x{i}" for i in range(6000))
    return documents([
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", None),
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", None),
        (3, None, None, "b"), (4, "", "en", "b"), (5, " \n\t ", None, "a"), (None, "no id here at all", "en", "a"),
        (6, long, "en", "c"), (7, "été \U0001d400\U0001d401 中文 !!", "fr", "c"), (8, "one", "en", None),
    ])
