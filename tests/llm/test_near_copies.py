from __future__ import annotations

import random
import re

from lathework.llm import nearcopies


def brute(rows):
    table = str.maketrans(nearcopies.UPPER, nearcopies.LOWER)
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return {k: (len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)}


def corpus(seed):
    """Families of near copies around the threshold, a passage that many share, and chains."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = word()
            base = own if rng.random() < 0.3 else base
            out.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    for _ in range(40):
        out.append(" ".join([*(word() for _ in range(rng.randrange(0, 40))), *passage]))
    out += ["x y", "x y", "x Y z", "", " ", None]
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out))


def check(df, rows):
    want = brute(rows)
    for r in nearcopies.near_copies(df).collect():
        n, least = want[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, least, r["doc_id"] == least)


def test_against_brute_force(documents):
    for seed in (1, 2):
        rows = corpus(seed)
        check(documents([(k, t, "en", "a") for k, t in rows]), rows)


def test_many_blocks(documents, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    rows = corpus(3)
    check(documents([(k, t, "en", "a") for k, t in rows]), rows)


def test_hot_values_hubs_and_classes_are_salted(documents, monkeypatch):
    from lathework.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    rows = corpus(4)
    base = [f"v{i}" for i in range(100)]
    rows += [(20_000 + i, " ".join(base)) for i in range(40)] + [(30_000 + i, " ".join([*base[:i], "odd", *base[i + 1 :]])) for i in range(40)]
    check(documents([(k, t, "en", "a") for k, t in rows]), rows)
    kept = {r["doc_id"] for r in nearcopies.keep_first(documents([(k, t, "en", "a") for k, t in rows])).collect()}
    assert len(kept & set(range(20_000, 40_000))) == 1


def test_one_line_in_all_documents(documents, monkeypatch):
    """A line that every document has neither links them nor makes them one family."""
    line = " ".join(f"notice{i}" for i in range(30))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(20 + i % 50)) + " " + line) for i in range(300)]
    rows += [(1000, rows[7][1] + " end"), (1001, rows[8][1])]
    seen = []
    monkeypatch.setattr(nearcopies, "mixed", lambda a, b, f=nearcopies.mixed: seen.append(f(a, b)) or seen[-1])
    check(documents([(k, t, "en", "a") for k, t in rows]), rows)
    assert max(df.select("id").distinct().count() for df in seen) <= 160  # of documents mostly made of the line


def test_bands_miss_no_link(documents):
    """Pairs at exactly 85 %, either way round, on both sides of every band's edge."""
    rows = []
    for n in range(7, 120):
        words = [f"n{n}w{j}" for j in range(n + 4)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[: -(-85 * n // 100) + 4])), (10 * n + 2, " ".join(words[: -(-85 * n // 100) + 3]))]
    check(documents([(k, t, "en", "a") for k, t in rows]), rows)


def test_components_of_a_path(spark):
    edges = spark.range(1, 60).selectExpr("id as a", "id - 1 as b")
    got = nearcopies.components(edges).collect()
    assert {r["id"] for r in got} == set(range(1, 60)) and {r["component"] for r in got} == {0}


def test_odd_rows(odd, documents):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nearcopies.near_copies(odd).collect()}
    assert {x for x in got if x[0] in (1, 2, 3, 4, None)} == {(1, 8, 1, True), (2, 8, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 1, None, True)}
    kept = nearcopies.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id = 1").count() == 1
    assert nearcopies.near_copies(documents([])).count() == 0


def test_keep_first_tells_rows_of_one_id_apart(documents):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    df = documents([(5, a, "en", "late"), (5, b, "en", "unique"), (1, a, "en", "early"), (7, c, "en", "twice"), (7, c, "en", "twice"), (None, a, "en", "no id")])
    kept = [(r["doc_id"], r["source"]) for r in nearcopies.keep_first(df).collect()]
    assert sorted(kept, key=repr) == [(1, "early"), (5, "unique"), (7, "twice"), (None, "no id")]


def stored(monkeypatch):
    """The names and plans of the tables that the operator stores from now on."""
    seen, store = [], nearcopies.store

    def spy(df, name, **more):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name, **more)

    monkeypatch.setattr(nearcopies, "store", spy)
    return seen


def test_components_against_brute_force(spark, monkeypatch):
    """Random graphs and trees; stars as they are take no step."""
    rng = random.Random(4)
    for n, m in ((60, 25), (60, 60), (30, 200), (0, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + k, 100 + k // 2) for k in range(1, 20)]
        least = {k: k for e in edges for k in e}
        for _ in least:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        got = {r["id"]: r["component"] for r in nearcopies.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: c for k, c in least.items() if c != k}
    seen = stored(monkeypatch)
    stars = spark.createDataFrame([(1, 3), (4, 1), (5, 9), (7, 7)], "a long, b long")
    assert {tuple(r) for r in nearcopies.components(stars).collect()} == {(3, 1), (4, 1), (9, 5)}
    assert len(seen) == 1


def test_nothing_is_broadcast(documents, monkeypatch):
    """Each broadcast passes the driver, whose memory the pipeline's many joins filled."""
    seen = stored(monkeypatch)
    rows = corpus(5)
    kept = nearcopies.keep_first(documents([(k, t, "en", "a") for k, t in rows]))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, (_, least) in brute(rows).items() if k == least}
    seen.append(("result", kept._jdf.queryExecution().executedPlan().toString()))
    assert {"rest-links", "rest"} <= {name for name, _ in seen}
    assert [name for name, plan in seen if "Broadcast" in plan] == []
