"""Language identification, toxicity, licences and neighbours."""

from __future__ import annotations

import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import langid, licences, neighbours, toxicity
from lathework.llm.common import held_out

WORDS = {"en": ["the", "house", "thing", "with", "that", "which", "shore", "there"], "de": ["der", "haus", "nicht", "schon", "auch", "zwischen", "wird"], "fr": ["le", "maison", "que", "dans", "leur", "avec", "beaucoup"]}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(8, 40))).capitalize() + ".", lang, "a"))
    return out


def test_held_out_is_the_crc_rule(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_profiles_against_counting(documents):
    from collections import Counter

    rows = [(1, "Ab ab!", "x", "a"), (2, "ab c", "x", "a"), (3, None, "x", "a"), (4, "zz", None, "a")]
    want = Counter()
    for _, t, lang, _ in rows:
        if t and lang:
            body = " " + " ".join(w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
            grams = [g for n in (1, 2, 3) for g in (body[i : i + n] for i in range(len(body) - n + 1)) if not (n == 1 and g == " ") and not (n == 3 and g[1] == " ")]
            want.update(grams)
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    ranked = [code(g) for g in sorted(want, key=lambda g: (-want[g], code(g)))][: langid.PROFILE]
    assert langid.train(documents(rows))["x"] == ranked


def test_language_accuracy(documents):
    rows = texts(300)
    df = documents(rows)
    got = {r["doc_id"]: r for r in langid.predict(df, langid.train(df.filter("doc_id < 200"))).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i >= 200]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd_rows(odd, documents):
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.train(odd)).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    assert got[1]["lang_pred"] == "en"
    assert langid.predict(odd, {}).first()["lang_pred"] == "und"
    assert langid.predict(documents([]), langid.train(documents([]))).count() == 0


WIDE = [9007199254740993, -9100000000000000000, 9100000000000000000, None]


def test_ids_stay_as_they_are(spark, documents):
    df = documents([(i, f"the house {i}", "en", "a") for i in WIDE])
    some = spark.createDataFrame([(WIDE[0], 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in langid.predict(df, langid.train(df)).collect()} == set(WIDE)
    assert {r["doc_id"] for r in toxicity.score(df, toxicity.train(df, some)).collect()} == set(WIDE)
    assert {r["doc_id"] for r in licences.scan(df).collect()} == set(WIDE)


def test_numerals_are_no_letters(documents):
    texts = {1: "\u00bd \u00b2 \u2167", 2: "the house", 3: "\u0915\u093f\u0924\u093e\u092c", 4: "\u0301", 5: "12 _ !"}
    df = documents([(i, t, "en", "a") for i, t in texts.items()])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langid.train(df.filter("doc_id = 2"))).collect()}
    assert [got[i] for i in (1, 4, 5)] == [("und", 0.0)] * 3 and got[2][0] == got[3][0] == "en"
    assert len(langid.grams(texts[3])) == 5 + 6 + 5  # one word: the vowel signs don't cut it


def profile_by_hand(text, size):
    from collections import Counter
    from unicodedata import category

    letters = "".join(c if category(c)[0] in "LM" else " " for c in text.lower())
    if not any(category(c)[0] == "L" for c in letters):
        return []
    body = " " + " ".join(letters.split(" ")).strip() + " "
    while "  " in body:
        body = body.replace("  ", " ")
    grams = Counter(g for n in (1, 2, 3) for g in (body[i : i + n] for i in range(len(body) - n + 1)) if g != " " and not (n == 3 and g[1] == " "))
    return sorted(grams, key=lambda g: (-grams[g], sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))))[:size]


def test_predictions_against_brute_force(documents, odd):
    """Out-of-place distances by hand, for every document."""
    rows = texts(80) + [(900, "\u00e9t\u00e9 \u00bd le", "fr", "a"), (901, None, None, "a"), (902, "?!", "de", "a")]
    df = documents(rows)
    size, profiles = langid.PROFILE, langid.train(df.filter("doc_id < 50"))
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    for r in langid.predict(df, profiles).collect():
        own = [code(g) for g in profile_by_hand(dict((i, t) for i, t, _, _ in rows)[r["doc_id"]] or "", size)]
        apart = {k: sum(abs(v.index(g) - i) if g in v else size for i, g in enumerate(own)) for k, v in profiles.items()}
        assert r["lang_pred"] == (min(apart, key=lambda k: (apart[k], k)) if own else "und")


def toxic_rows(n, seed=2):
    rng = random.Random(seed)
    stock = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "sk", "l")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(stock) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilehead", "vileness", "snarkle"]))
        rows.append((i, " ".join(words), "en", "a"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels, {i for i, t, _, _ in rows if "vile" in t or "snarkle" in t}


@pytest.fixture
def labelled(spark, documents):
    rows, labels, bad = toxic_rows(1500)
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bad


def test_toxicity_learns(labelled):
    df, labels, bad = labelled
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    held = [r for r in got if r["held_out"]]
    wrong = [r for r in held if (r["predicted"] == 1) != (r["doc_id"] in bad)]
    assert len(wrong) <= 0.02 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns
    assert abs(kept.count() - (df.count() - len(bad))) <= 0.02 * df.count()


def test_toxicity_odd_rows(spark, odd, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, none)).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 0, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.train(odd, some)).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(documents([]), toxicity.train(documents([]), some)).count() == 0


def test_positives_only(labelled):
    """Without a labelled negative the prior is estimated, and clean documents stay."""
    df, labels, bad = labelled
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.train(df, labels.filter("toxic = 1"))).collect()}
    clean = [p for i, p in got.items() if i not in bad]
    assert sum(clean) <= 0.03 * len(clean)
    assert sum(got[i] for i in bad) >= 0.9 * len(bad)
    assert toxicity.keep_clean(df, labels.filter("toxic = 1")).count() >= 0.95 * len(clean)
    few = toxicity.train(df, labels.filter("toxic = 1"), prior=0.15)
    assert few.score(set()) < toxicity.THRESHOLD


def test_scores_against_brute_force(labelled):
    df, labels, _ = labelled
    model = toxicity.train(df, labels)
    for r in toxicity.score(df, model).join(df.select("doc_id", "text"), "doc_id").collect():
        found = {f for w in toxicity.WORDS.findall(r["text"].lower()) for f in [w + "$", *(w[:k] for k in toxicity.PREFIXES if len(w) >= k)]}
        z = model.bias + sum(model.weights[f] for f in found if f in model.weights)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_clean_rows_keep_every_column(spark):
    wide = 9007199254740993
    df = spark.createDataFrame([(wide, "a b", float("nan"), wide), (None, None, 1.0, None)], "doc_id long, text string, x double, y long")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, toxic int")
    got = toxicity.keep_clean(df, labels)
    assert got.schema == df.schema
    rows = {r["y"]: r for r in got.collect()}
    assert set(rows) == {wide, None} and rows[wide]["x"] != rows[wide]["x"] and rows[wide]["doc_id"] == wide


def test_nnpu_separates_without_negatives():
    rows = [(True, [0])] * 50 + [(False, [0])] * 20 + [(False, [1])] * 180
    model = toxicity.fit(rows, ["bad", "plain"], 0.1)
    assert model.score({"bad"}) > 0.8 and model.score({"plain"} & set(model.weights)) < 0.2


def test_licences(documents):
    rows = texts(120)
    rows += [(500, "some words here\nReleased under the MIT License.\nmore", "en", "a"), (501, "Licensed under CC BY-NC 4.0.", "en", "a"), (502, "we speak of a license to drive and of general matters", "en", "a")]
    got = {r["doc_id"]: r for r in licences.scan(documents(rows)).collect()}
    assert list(got[500]["families"]) == ["mit"] and got[500]["paragraphs"][0]["paragraph"] == 1
    assert list(got[501]["families"]) == ["cc-by-nc"]
    assert not any(got[i]["families"] for i in [*range(120), 502])


def test_licences_wrapped_and_dual(documents):
    isc = "Copyright someone\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
    nc = "Text here\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."
    rows = texts(120)
    rows += [(600, isc, "en", "a"), (601, nc, "en", "a"), (602, "You may use it under the MIT License or the Apache License, Version 2.0.", "en", "a")]
    rows += [(603, "All rights reserved.\nsomething else\nAll rights reserved.\n\nLicensed under the\nMIT License", "en", "a"), (604, "Licensed under the Apache\n\nLicense in another paragraph", "en", "a")]
    got = {r["doc_id"]: r for r in licences.scan(documents(rows)).collect()}
    assert {i: list(got[i]["families"]) for i in range(600, 605)} == {600: ["isc"], 601: ["cc-by-nc"], 602: ["apache", "mit"], 603: ["mit", "proprietary"], 604: []}
    assert [x["paragraph"] for x in got[600]["paragraphs"]] == [1] and [x["paragraph"] for x in got[603]["paragraphs"]] == [0, 2, 3]
    assert got[603]["n_paragraphs"] == 5
    assert not any(got[i]["families"] for i in range(120))


def test_licences_learn_from_all_paragraphs(documents, monkeypatch):
    bodies = ["we grant permission to use and copy this work for any purpose", "the general terms of the public software license " * 300]
    rows = [(i, f"\nTitle{i}\n\n{bodies[i % 2]}\nclosing", "en", "a") for i in range(200)]
    rows += [(1000, "Released under the MIT License.", "en", "a")]
    df, seen = documents(rows), []
    monkeypatch.setattr(licences, "train", lambda own, f=licences.train: seen.extend(own) or f(own))
    got = {r["doc_id"]: list(r["families"]) for r in licences.scan(df).collect()}
    assert got.pop(1000) == ["mit"] and not any(got.values())
    assert len(seen) == 600  # all paragraphs but the notice
    heads = {" ".join(h) for _, h in seen}
    assert bodies[0] in heads and "closing" in heads and all(len(h) <= licences.HEAD for _, h in seen)
    # the threshold counts every paragraph: few documents score high, and most not at all
    model = licences.Classifier(licences.vocabulary(), [*sorted(licences.NOTICES), "unknown"], np.zeros((len(licences.vocabulary()) + 1, len(licences.NOTICES) + 1)), 0.0)
    model.weights[model.at["copy"], 3] = 6.0
    p = float(model.probabilities({"copy"})[3])
    least = licences.calibrate(df, model)
    assert p < least < p + 0.001
    monkeypatch.setattr(licences, "FALSE_SHARE", 0.5)
    assert licences.calibrate(df, model) == 0.5


def test_short_notices_inside_prose(documents):
    rows = texts(60)
    prose = ["we do it so that all rights reserved for us are kept", "they said all rights reserved\nfor others were lost", "Copyright 2020 Acme. All rights reserved.", "All rights reserved. Do not copy."]
    rows += [(700 + i, t, "en", "a") for i, t in enumerate(prose)]
    got = {r["doc_id"]: list(r["families"]) for r in licences.scan(documents(rows)).collect()}
    assert [got[700 + i] for i in range(4)] == [[], ["proprietary"], ["proprietary"], ["proprietary"]]


def test_precision_and_recall_on_varied_notices(documents):
    """Every notice once, those of over five words with one word that training never saw,
    set in prose, against prose that scatters the same words."""
    rng = random.Random(9)
    rows, want = texts(150), {}
    stock = sorted({w for ts in licences.NOTICES.values() for t in ts for w in licences.tokens(t)})
    for family, ts in licences.NOTICES.items():
        for t in ts:
            words = t.split()
            if len(words) > 5:
                at = rng.randrange(len(words))
                words[at] = "zq" + words[at]
            want[2000 + len(want)] = family
            rows.append((1999 + len(want), "something before\n" + " ".join(words) + "\nand after", "en", "a"))
    near = range(5000, 5120)
    rows += [(i, " ".join(x for _ in range(25) for x in (rng.choice(stock), f"plain{rng.randrange(50)}")), "en", "a") for i in near]
    got = {r["doc_id"]: list(r["families"]) for r in licences.scan(documents(rows)).collect()}
    right = sum(want[i] in got[i] for i in want)
    named = sum(len(x) for x in got.values())
    print("recall", right / len(want), "precision", right / named)
    assert right / len(want) >= 0.9 and right / named >= 0.9
    assert sum(bool(got[i]) for i in near) <= 2 and not any(got[i] for i in range(150))


def test_licences_odd_rows(odd, documents):
    assert licences.scan(odd).count() == 10
    assert licences.scan(documents([])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, query, k):
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None]
    q = next(v for i, v in own if i == query)
    return sorted((float(np.sqrt(sum((v - q) ** 2))), i) for i, v in own if i != query)[:k]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(2000)]
    rows += [(2000 + i, rows[0][1]) for i in range(700)]  # one very common vector
    table = neighbours.vectors(vectors(spark, [(i, v, 0) for i, v in rows]))
    asked = table.filter("vec_id % 100 = 0").selectExpr("vec_id as query_id", "v as q")
    found: dict[int, list] = {}
    for r in neighbours.search(table, asked).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert len(found) == asked.count()
    hit = 0
    for query, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        want = brute(rows, query, 10)
        hit += len({i for _, i in want} & {i for _, _, i in own})
    assert hit / (10 * len(found)) >= 0.9
    want = brute(rows, 0, 10)
    assert [i for _, _, i in sorted(found[0])] == [i for _, i in want]


def test_neighbours_odd_rows(spark):
    bad = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0)]
    good = [(100, [1.0, 0.0], 0), (7, [1.0, 1.0], 0), (8, [2.0, 0.0], 0)]
    table = neighbours.vectors(vectors(spark, bad + good))
    asked = table.filter("vec_id % 100 = 0").selectExpr("vec_id as query_id", "v as q")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(table, asked).collect())
    assert got == [(1, 7, 1.0), (2, 8, 1.0)]
    assert neighbours.search(neighbours.vectors(vectors(spark, bad[:1])), asked.limit(0)).count() == 0


def test_neighbours_of_every_length(spark):
    rows = [(i, [float(i % 7), float(i % 5)], 0) for i in range(1, 40)] + [(100 + i, [float(i), 1.0, 2.0], 0) for i in range(12)] + [(200, [5.0], 0), (201, [7.0], 0)]
    table = neighbours.vectors(vectors(spark, rows))
    asked = table.filter("vec_id % 100 = 0").selectExpr("vec_id as query_id", "v as q")
    got: dict[int, list] = {}
    for r in neighbours.search(table, asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[200]) == [(1, 201, 2.0)]
    assert sorted(got[100]) == [(i, 100 + i, float(i)) for i in range(1, 11)]




def test_vectors_too_large_to_be_squared(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 10.0 ** (200 if i < 30 else 0)).tolist()) for i in range(60)] + [(100, [1.5e308] * 6), (101, [-1.5e308] * 6)]
    table = neighbours.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    asked = table.filter("vec_id in (0, 40, 100)").selectExpr("vec_id as query_id", "v as q")
    found = {}
    for r in neighbours.search(table, asked, k=61, recall=1.0).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for query in (0, 40, 100):
        q = np.array(dict(rows)[query]) / 1e200
        want = {i: np.sqrt((((np.array(v) / 1e200) - q) ** 2).sum()) * 1e200 for i, v in rows if i != query}
        assert set(found[query]) == set(want)
        far = {i: d for i, d in want.items() if d > 1e100}  # of doubles, the farthest is infinite
        assert {i: found[query][i] for i in far} == pytest.approx(far)
    near = {i: np.sqrt(((np.array(v) - dict(rows)[40]) ** 2).sum()) for i, v in rows[30:60] if i != 40}
    assert {i: found[40][i] for i in near} == pytest.approx(near)


def test_licence_lines_take_linear_time():
    model = licences.train([])
    for lines in (1_000, 32_000):
        text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\n" + "some other line of a log\n" * lines
        began = time.perf_counter()
        n, found = model.document(text)
        took = time.perf_counter() - began
        assert n == lines + 1 and {i for i, _, _ in found} <= {0}
    assert took < 3


def test_recall_on_the_drivers_table(spark):
    """Recall at 10 of the registered query against brute force over the whole table."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    found: dict[int, list] = {}
    for r in neighbours.op3_neighbours(spark, folder).collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hit = 0
    for query, own in found.items():
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[:, j] - x[ids == query][0, j]) ** 2
        d = np.sqrt(d)
        want = sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != query)[:10]
        assert set(own) <= set(zip(d.tolist(), ids.tolist()))
        hit += len(set(want) & set(own))
    assert len(found) == (ids % 100 == 0).sum()
    print("recall", hit / (10 * len(found)))
    assert hit / (10 * len(found)) >= 0.9
