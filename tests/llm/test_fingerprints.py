from __future__ import annotations

import hashlib

from lathework.llm import fingerprints


def edited(rows):
    """(doc_id, edited text) by brute force."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        c = len(t) // 4
        out.append((k, len(t), hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts_over_many_runs(documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 7)
    rows = [((i * i) % 10_007, f"text {i} " * (i % 13)) for i in range(100)]
    got = fingerprints.fingerprints(documents([(k, t, "en", "a") for k, t in rows]).repartition(9)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == edited(rows)


def test_wide_ids(documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 3)
    rows = [(i * 910_000_000_000_000_000, f"text {i}") for i in range(-10, 11)] + [(9223372036854775807, "last"), (-9223372036854775808, "first")]
    got = fingerprints.fingerprints(documents([(k, t, "en", "a") for k, t in rows])).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == edited(rows)


def test_signature_against_brute_force(spark, documents):
    """The tuple of every slot, worked out by hand from hashes that Spark gives."""
    import regex
    from pyspark.sql import functions as F

    text = "one two, three four five six one two three! " * 3
    units = regex.findall(fingerprints.UNITS, text)
    n, keep = max(1, len(units) - fingerprints.KMER + 1), ~fingerprints.PLACE
    units = [r[0] for r in spark.createDataFrame(list(enumerate(units)), "i int, u string").orderBy("i").select(F.xxhash64("u")).collect()]
    grams = [tuple(units[i : i + fingerprints.KMER]) for i in range(n)]
    hashed = [r[0] for r in spark.createDataFrame([(i, *g) for i, g in enumerate(grams)], "i int, a long, b long, c long").orderBy("i").select(F.xxhash64("a", "b", "c")).collect()]
    seen, marked = {}, []
    for at, h in enumerate(hashed):
        high = h >> fingerprints.BITS
        marked.append((high, seen.get(high, 0), at))
        seen[high] = seen.get(high, 0) + 1
    again = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(marked)], "i int, a long, b int").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    circle = sorted((h & keep) | at for h, (_, _, at) in zip(again, marked))
    slots = []
    for j in range(fingerprints.SLOTS):
        mark = (j - fingerprints.SLOTS // 2) << (64 - fingerprints.SLOTS.bit_length() + 1)
        first = sum(x < mark for x in circle)
        took = [circle[(first + t) % len(circle)] for t in range(fingerprints.PICK)]
        slots.append([x >> fingerprints.BITS for x in sorted(took, key=lambda x: x & fingerprints.PLACE)])
    want = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(slots)], "i int, s array<long>").orderBy("i").select(F.shiftright(F.xxhash64("s"), 32).cast("int")).collect()]
    got = fingerprints.fingerprints(documents([(1, text, "en", "a")])).first()["fingerprint"]
    assert got == "".join(f"{w & 0xFFFFFFFF:08x}".upper() for w in want)


def test_likeness(documents):
    words = [f"{a}{b}" for a in ("red", "green", "blue", "fast", "slow") for b in range(60)]
    base = " ".join(words)
    swapped = " ".join(words[150:] + words[:150])
    near = " ".join("new" if i % 25 == 0 else w for i, w in enumerate(words))
    df = documents([(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "a"), (4, "entirely other words here " * 20, "en", "a"), (5, swapped, "en", "a")])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0
    assert 0.5 < got[2]["near_next"] < 1.0
    assert got[3]["near_next"] == 0.0
    a, b = got[1]["fingerprint"], got[5]["fingerprint"]
    same = sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / fingerprints.SLOTS
    assert 0.2 < same < 0.95  # the same k-mers, but many pairs changed order


def test_occurrences_count(documents):
    got = fingerprints.fingerprints(documents([(1, "ab " * 50, "en", "a"), (2, "ab " * 60, "en", "a"), (3, "ab", "en", "a")])).collect()
    assert len({r["fingerprint"] for r in got}) == 3


def test_odd_rows(odd, documents):
    got = fingerprints.fingerprints(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == edited(rows)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert all(len(r["fingerprint"]) == 8 * fingerprints.SLOTS and 0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprints.fingerprints(documents([])).count() == 0
    assert fingerprints.fingerprints(documents([(5, "one two three four", "en", "a")])).first()["near_next"] == 1.0


def test_no_python_in_the_plan(documents):
    plan = fingerprints.fingerprints(documents([(1, "a b c", "en", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
