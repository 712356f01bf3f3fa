from __future__ import annotations

import hashlib
import re

from lathework.llm import private

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * x - 9 if 2 * x > 9 else 2 * x) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m.group())] for k, p in PATTERNS.items()}


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])


TEXTS = [
    "mail me at jo.e+x@mail.example.com, or a@b.c%d@e.f and 1.2.3.4.5 or 300.1.1.1 \U0001d400 10.0.0.255",
    "card 4111 1111 1111 1111 and 4111111111111111-0000, phone +1 (555) 010-9999. +44 1",
    "+1 (319) 555-5132 4111111111111111 then", "x@y", "@@@", "+" * 50, "1" * 30_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "0001.02.3.4 +1234567890123456", "9 " * 40,
    "é中 a@b.co \U0001f600 +49 30 1234567", "1.2.3.4" * 200,
]


def test_base_spans_against_brute_force(documents):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(99, None, None, None), (100, "", "en", "a")]
    for r in private.digest(private.find(documents(rows))).collect():
        text = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        want = base(text)
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r["spans"].split(",")) | {""}


def test_boosting_adds_what_a_failed_run_hides(documents):
    rows = [(i, f"call +1 (319) 555-{1000 + i} now, or pay 4111111111111111 ok", "en", "a") for i in range(200)]
    rows += [(1000, "so +1 (319) 555-5132 4111111111111111 end", "en", "a"), (1001, "an order number 1234567812345678 and nothing else", "en", "a")]
    got = {r["doc_id"]: r["spans"] for r in private.digest(private.find(documents(rows))).collect()}
    assert got[1000] == "card:21:37,phone:3:20"
    assert got[1001] == ""


def test_thresholds_count_all_candidates(documents, monkeypatch):
    monkeypatch.setattr(private, "COMBINATIONS", 2)
    rows = [(i, f"call +1 (319) 555-{1000 + i} now", "en", "a") for i in range(100)]
    df = private.with_candidates(private.with_base(documents(rows)))
    assert 3 in private.train(df)[1]
    rare = [f"ring {'555-1234 ' * (i % 3 + 1)}{'(0)' * (i % 4)} {10**(i % 7) + 1000000}{'-12' * (i % 5)} or" for i in range(300)]
    df = private.with_candidates(private.with_base(documents(rows + [(1000 + i, x, "en", "a") for i, x in enumerate(rare)])))
    assert 3 not in private.train(df)[1]


def test_redact(documents):
    df = documents([(1, "a a@b.co and 10.0.0.1!", "en", "a"), (2, "clean", "en", "a"), (3, None, None, None)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in private.redact(df).collect()}
    assert private.redact(df).columns == df.columns
    assert got == {1: ("a [EMAIL] and [IP]!", 19), 2: ("clean", 5), 3: (None, None)}


def test_redact_cuts_at_block_edges(documents, monkeypatch):
    monkeypatch.setattr(private, "CUT", 8)
    texts = [f"{'x ' * k}a@b.co{' y' * (k % 7)} 10.0.0.{k} c@d.ef,g@h.ij {'\u4e2d' * k} k@l.mn" for k in range(40)]
    got = {r["doc_id"]: r["text"] for r in private.redact(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = re.sub(PATTERNS["email"], "[EMAIL]", t)
        assert got[i] == re.sub(PATTERNS["ip"], "[IP]", want)


def test_additions_keep_off_base_spans(documents, monkeypatch):
    """Every proposal is accepted: what is added overlaps no base span, and of
    proposals that overlap each other none is both worse and added."""
    rows = [(i, t, "en", "a") for i, t in enumerate([*TEXTS, "0319 555-5132 a@b.co 10.1.1.300 (031) 555-4444.10.1.1.1 " * 40])]
    df = private.with_candidates(private.with_base(documents(rows)))
    model = private.Boosted()
    model.trees = [(1, 9, 0.5, 1.0)]
    for r in private.with_spans(df, model, dict.fromkeys(range(4), 0.0)).collect():
        base_ = [(m["start"], m["end"]) for m in r["base"]]
        meet = lambda a, b: a[0] < b[1] and b[0] < a[1]
        good = [c for c in r["candidates"] if not c["is_base"] and not any(meet((c["start"], c["end"]), o) for o in base_)]
        rank = lambda c: (0.5 if c["digits"] <= 9 else 1.0, -c["start"], c["end"] - c["start"], -c["kind"])
        want = {(c["kind"], c["start"], c["end"]) for c in good if not any(meet((c["start"], c["end"]), (o["start"], o["end"])) and rank(o) > rank(c) for o in good)}
        assert {tuple(m) for m in r["spans"]} == want | {(m["kind"], m["start"], m["end"]) for m in r["base"]}
        keys = [(c["kind"], c["start"], c["end"]) for c in r["candidates"]]
        assert len(keys) == len(set(keys)) and sum(c["is_base"] for c in r["candidates"]) == len(base_)


def test_no_python_in_the_plan(documents):
    plan = private.find(documents([(1, "a@b.co", "en", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_odd_rows(odd, documents):
    assert private.digest(private.find(odd)).count() == 10
    assert private.digest(private.find(documents([]))).count() == 0
