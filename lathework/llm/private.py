"""Operator 9: personal data by gradient boosting over candidate spans, in
DataFrame functions only.

Base spans come from four patterns and their checks and always stay. Beside
them, high-recall generators propose overlapping candidates of the same kinds,
also inside longer runs that fail a base check (a phone number with a card
number behind it). Boosted trees score each candidate by format and context
features; a candidate is added where its score reaches the threshold of its
kind and no base span and no better addition overlaps it.

The trees learn from weak labels: a candidate is positive if it is a base
span. Spark counts candidates and positives by feature values over all
documents; boosting runs on that table of distinct feature values (the commonest
ones, at most ``COMBINATIONS`` rows, reach the driver). Trees and thresholds
become one column expression, so that scoring is a projection. Thresholds are
calibrated on all candidates of the documents whose crc32 leaves 2, which Spark
scores and counts: the least score (in steps of ``STEP``) whose additions would
be right ``PRECISION`` of the time by weak label.

Start positions come from the lengths between matches. Repetitions in the
patterns are possessive, which matches the same strings (what follows them
can't begin inside them) without backtracking or deep recursion on long runs.

Cases: null and empty texts have no spans; nothing is kept between rows, so
that repeated rows and null ids are treated like any other; an empty table
gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, held_out, store

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": rf"(?<!{LOCAL}){LOCAL}{{1,64}}+\x20?(?:@|\(at\)|\[at\])\x20?{HOST}{{1,63}}+(?:\.{HOST}{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}[0-9]{0,3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: A text without these has neither spans nor candidates.
TRIGGER = r"[0-9@]|[(\[]at[)\]]"

FEATURES = ("kind", "digits", "size", "groups", "plus", "dots", "luhn", "octets", "before", "after")
COMBINATIONS = 20_000
ROUNDS, DEPTH, SHRINK, LEAST = 40, 3, 0.3, 2.0
PRECISION = 0.9
#: Scores are counted in such steps.
STEP = 1e-3
#: More candidates than can start within the longest one (645 characters, at most 292 starts).
REACH = 512
#: Characters of a block of a text that is cut into pieces.
CUT = 1024


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is worked out once,
    however often ``body`` uses it and whatever the optimizer inlines."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ends(lengths: str) -> str:
    """SQL: running sums of an array of ints that isn't empty, by blocks of 32,
    so that long arrays don't take quadratic time."""
    sum_of = lambda a: f"aggregate({a}, 0, (t, x) -> t + x)"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div 32), b -> {sum_of(f'slice({lengths}, 32 * b + 1, 32)')})"
    starts = f"transform(sequence(0, size(s) - 1), b -> {sum_of('slice(s, 1, b)')})"
    inside = f"transform({lengths}, (x, i) -> get(o, i div 32) + {sum_of(f'slice({lengths}, 32 * (i div 32) + 1, i % 32 + 1)')})"
    return let("s", blocks, let("o", starts, inside))


SPAN = "array<struct<kind: int, start: int, end: int, value: string, before: string, after: string>>"


def _largest_so_far(values: str) -> str:
    """SQL: running maxima of an array of ints that isn't empty, by blocks of 32."""
    blocks = f"transform(sequence(0, (size({values}) - 1) div 32), b -> array_max(slice({values}, 32 * b + 1, 32)))"
    starts = "transform(sequence(0, size(s) - 1), b -> coalesce(array_max(slice(s, 1, b)), -1))"
    inside = f"transform({values}, (x, i) -> greatest(get(o, i div 32), array_max(slice({values}, 32 * (i div 32) + 1, i % 32 + 1))))"
    return let("s", blocks, let("o", starts, inside))


def spans(kind: int, pattern: str) -> str:
    """SQL: structs (kind, start, end, value, before, after) of a pattern's matches
    in ``text``; the last two are the characters beside, taken from the text
    between matches, so that no match searches the text from its beginning."""
    before = "if(length(get(g, i)) > 0, right(get(g, i), 1), if(i > 0, right(get(m, i - 1), 1), ''))"
    after = "if(length(get(g, i + 1)) > 0, left(get(g, i + 1), 1), coalesce(left(get(m, i + 1), 1), ''))"
    struct = f"transform(m, (x, i) -> named_struct('kind', {kind}, 'start', get(e, i) - length(x), 'end', get(e, i), 'value', x, 'before', {before}, 'after', {after}))"
    steps = "transform(m, (x, i) -> length(x) + length(get(g, i)))"
    placed = let("g", f"split(text, r'{pattern}', -1)", let("l", steps, let("e", _ends("l"), struct)))
    return let("m", f"if(_may, regexp_extract_all(text, r'{pattern}', 0), array())", f"if(size(m) = 0, cast(array() as {SPAN}), {placed})")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: the check sum of a string of digits is a multiple of ten."""
    twice = f"cast(substring(reverse({digits}), i + 1, 1) as int) * (1 + i % 2)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + {twice} - if({twice} > 9, 9, 0)) % 10 = 0)"


def _octets(value: str) -> str:
    part = "ltrim('0', x)"
    return f"forall(split({value}, '[.]'), x -> length({part}) <= 3 and coalesce(try_cast(concat('0', {part}) as int), 0) <= 255)"


VALID = {
    "email": "true",
    "ip": _octets("m.value"),
    "card": f"(length({_digits('m.value')}) between 16 and 19 and {_luhn(_digits('m.value'))})",
    "phone": f"length({_digits('m.value')}) between 8 and 15",
}


def with_base(table: DataFrame) -> DataFrame:
    """Adds base_<kind> arrays to rows that have ``text``; null text becomes empty."""
    df = table.withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("_may", F.col("text").rlike(TRIGGER))
    return df.withColumns({f"base_{k}": F.expr(f"filter({spans(i, BASE[k])}, m -> {VALID[k]})") for i, k in enumerate(KINDS)})


def _side(at: str) -> str:
    """SQL: what a neighbouring character is: nothing or blank, letter, digit, other."""
    return f"case when trim({at}) = '' then 0 when {at} rlike '[A-Za-z]' then 1 when {at} rlike '[0-9]' then 2 else 3 end"


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``base`` and ``candidates``, all kinds in one array; the latter have
    features and ``is_base``."""
    df = df.withColumn("base", F.concat(*[F.col(f"base_{k}") for k in KINDS]))
    # Base spans come before equal proposals, which are then left out.
    tagged = lambda array, tag: f"transform({array}, m -> named_struct('kind', m.kind, 'start', m.start, 'end', m.end, 'tag', {tag}, 'm', m))"
    proposals = f"concat({', '.join(spans(i, CANDIDATES[k]) for i, k in enumerate(KINDS))})"
    first = "i = 0 or t.kind != get(p, i - 1).kind or t.start != get(p, i - 1).start or t.end != get(p, i - 1).end"
    d = _digits("m.value")
    features = {
        "kind": "m.kind",
        "digits": f"least(length({d}), 20)",
        "size": "least(length(m.value), 40) div 4",
        "groups": "least(regexp_count(m.value, '[0-9]+'), 6)",
        "plus": "cast(m.value like '+%' as int)",
        "dots": "least(regexp_count(m.value, '[.]'), 4)",
        "luhn": f"if(m.kind = 2 and length({d}) between 13 and 19, cast({_luhn(d)} as int), 2)",
        "octets": f"if(m.kind = 1, cast({_octets('m.value')} as int), 2)",
        "before": _side("m.before"),
        "after": _side("m.after"),
    }
    fields = ", ".join(f"'{k}', {v}" for k, v in features.items())
    struct = let("m", "t.m", f"named_struct({fields}, 'start', m.start, 'end', m.end, 'is_base', t.tag = 0)")
    every = let("p", f"sort_array(concat({tagged('base', 0)}, {tagged(proposals, 1)}))", f"transform(filter(p, (t, i) -> {first}), t -> {struct})")
    return df.withColumn("candidates", F.expr(every))


class Boosted:
    """Boosted regression trees on the logistic loss, over distinct feature rows
    with counts. A tree is a value or (feature, split, low, high)."""

    def __init__(self) -> None:
        self.trees: list = []

    @staticmethod
    def value(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return sum(self.value(t, row) for t in self.trees)

    def fit(self, rows: list[tuple[tuple[int, ...], float, float]]) -> Boosted:
        """rows: (features, count, positives)."""
        z = [0.0] * len(rows)
        for _ in range(ROUNDS if rows else 0):
            p = [1 / (1 + math.exp(-x)) for x in z]
            g = [pos - n * q for (_, n, pos), q in zip(rows, p, strict=True)]
            h = [n * q * (1 - q) for (_, n, _), q in zip(rows, p, strict=True)]
            tree = self._grow(rows, g, h, list(range(len(rows))), DEPTH)
            self.trees.append(tree)
            z = [x + self.value(tree, r[0]) for x, r in zip(z, rows, strict=True)]
        return self

    def _grow(self, rows, g, h, own, depth):
        sum_g, sum_h = sum(g[i] for i in own), sum(h[i] for i in own)
        best = (1e-6, None)
        if depth:
            for f in range(len(FEATURES)):
                sums: dict[int, list[float]] = {}
                for i in own:
                    s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                    s[0] += g[i]
                    s[1] += h[i]
                lo_g = lo_h = 0.0
                for v in sorted(sums)[:-1]:
                    lo_g, lo_h = lo_g + sums[v][0], lo_h + sums[v][1]
                    hi_g, hi_h = sum_g - lo_g, sum_h - lo_h
                    gain = lo_g**2 / (lo_h + LEAST) + hi_g**2 / (hi_h + LEAST) - sum_g**2 / (sum_h + LEAST)
                    if gain > best[0]:
                        best = (gain, (f, v))
        if best[1] is None:
            return SHRINK * sum_g / (sum_h + LEAST)
        f, v = best[1]
        low = [i for i in own if rows[i][0][f] <= v]
        high = [i for i in own if rows[i][0][f] > v]
        return (f, v, self._grow(rows, g, h, low, depth - 1), self._grow(rows, g, h, high, depth - 1))

    def sql(self, of: str) -> str:
        def text(tree) -> str:
            if isinstance(tree, tuple):
                return f"if({of}.{FEATURES[tree[0]]} <= {tree[1]}, {text(tree[2])}, {text(tree[3])})"
            return f"{tree:.17e}D"

        return " + ".join(map(text, self.trees)) or "0.0D"


def train(df: DataFrame) -> tuple[Boosted, dict[int, float]]:
    """Trees from the commonest feature rows; each kind's threshold from all
    candidates, counted by fold, kind and score in steps of ``STEP``."""
    fold = held_out(F.col("doc_id")).alias("fold")
    each = df.select(fold, F.explode("candidates").alias("c")).groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
    every = store(each.agg(F.count("*").alias("n"), F.sum(F.col("c.is_base").cast("long")).alias("pos")), "counts")
    counts = every.orderBy(F.desc("n"), "fold", *FEATURES).limit(COMBINATIONS)
    rows = [(r["fold"], (tuple(r[f] for f in FEATURES), float(r["n"]), float(r["pos"]))) for r in counts.collect()]
    rows.sort(key=lambda x: (x[0], x[1][0]))
    model = Boosted().fit([r for fold, r in rows if not fold])
    step = F.floor(F.expr(model.sql("c")) / F.lit(STEP)).alias("step")
    scored = every.select("fold", "kind", "n", "pos", F.struct(*FEATURES).alias("c")).groupBy("fold", "kind", step).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    checked = [r for r in scored if r["fold"]] or scored
    thresholds = {}
    for kind in range(len(KINDS)):
        n = right = 0
        for r in sorted((r for r in checked if r["kind"] == kind), key=lambda r: -r["step"]):
            n, right = n + r["n"], right + r["pos"]
            if r["pos"] / r["n"] >= PRECISION and right / n >= PRECISION:
                thresholds[kind] = r["step"] * STEP - 1e-9
    return model, thresholds


def _free_of_base() -> str:
    """SQL: those of ``n`` (sorted structs with start and end) that no span of ``b``
    overlaps, in linear time: the spans that start before a candidate ends are
    counted by sorting both ends into one array of longs (position, whose, index),
    and the largest end among them says whether one reaches the candidate."""
    whose, index = 1 << 30, (1 << 30) - 1
    ends = f"transform(n, (c, i) -> c.end * 2147483648L + i)"
    starts = f"transform(b, o -> o.start * 2147483648L + {whose}L)"
    sorted_b = "transform(sort_array(transform(b, o -> o.start * 2147483648L + o.end)), x -> cast(x & 2147483647L as int))"
    hit = f"p - r > 0 and get(most, p - r - 1) > get(n, cast(get(both, p) & {index}L as int)).start"
    each = f"transform(at, (p, r) -> if({hit}, null, get(n, cast(get(both, p) & {index}L as int))))"
    at = f"filter(sequence(0, size(both) - 1), i -> get(both, i) & {whose}L = 0)"
    found = let("at", at, f"sort_array(filter({each}, c -> c is not null))")
    return let("both", f"sort_array(concat({ends}, {starts}))", let("v", sorted_b, let("most", _largest_so_far("v"), found)))


def with_spans(df: DataFrame, model: Boosted, thresholds: dict[int, float]) -> DataFrame:
    """Adds ``spans``: structs (kind, start, end) of the base and the additions, sorted."""
    least = ", ".join(f"{thresholds[k]:.17e}D" if k in thresholds else "double('inf')" for k in range(len(KINDS)))
    scored = f"transform(filter(candidates, c -> not c.is_base), c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'score', {model.sql('c')}))"
    good = f"sort_array(filter({scored}, c -> c.score >= get(array({least}), c.kind)))"
    free = f"if(size(b) = 0 or size(n) = 0, n, {_free_of_base()})"
    better = "struct(o.score, -o.start, o.end - o.start, -o.kind) > struct(c.score, -c.start, c.end - c.start, -c.kind)"
    near = f"slice(g, greatest(i - {REACH}, 0) + 1, {2 * REACH})"
    added = f"filter(g, (c, i) -> not exists({near}, o -> o.start < c.end and c.start < o.end and {better}))"
    plain = "m -> named_struct('kind', m.kind, 'start', m.start, 'end', m.end)"
    both = let("b", "base", let("n", good, let("g", free, f"sort_array(concat(transform(b, {plain}), transform({added}, {plain})))")))
    return df.withColumn("spans", F.expr(both))


def as_text(array: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({array}, m -> concat_ws(':', get(array({names}), m.kind), m.start, m.end)), ',')")


def find(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """base_<kind>, base and spans of every row of ``table`` (doc_id, text).

    Spans and candidates are stored, so that texts are searched once for both
    training and scoring; ``keep`` names columns to carry along, for which the
    texts are searched again."""
    df = with_candidates(with_base(table))
    found = store(df.select("doc_id", *[f"base_{k}" for k in KINDS], "base", "candidates"), "candidates")
    model, thresholds = train(found)
    return with_spans(df if keep else found, model, thresholds)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"),
        as_text("spans").alias("spans"),
    )


def redact(table: DataFrame) -> DataFrame:
    """``table`` with every span replaced by its kind in brackets, n_chars anew.
    Overlapping spans count as one, named after the first."""
    own = table.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("_lw_row"))
    df = find(own, keep=("text", "_lw_row"))
    ordered = "sort_array(transform(spans, m -> named_struct('start', m.start, 'end', m.end, 'kind', m.kind)))"
    # A span begins a run unless one before it reaches over its start.
    heads = "filter(sequence(0, size(w) - 1), i -> i = 0 or get(w, i).start >= get(most, i - 1))"
    runs = "transform(h, (i, r) -> named_struct('start', get(w, i).start, 'end', get(most, coalesce(get(h, r + 1), size(w)) - 1), 'kind', get(w, i).kind))"
    joined = let("w", ordered, let("v", "transform(w, m -> m.end)", let("most", _largest_so_far("v"), let("h", heads, runs))))
    tags = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    blocks = f"transform(sequence(0, length(text) div {CUT}), k -> substring(text, k * {CUT} + 1, {CUT}))"

    def piece(start: str, end: str) -> str:
        """SQL: text[start:end] from blocks, without going through the text from its beginning."""
        first, last = f"(({start}) div {CUT})", f"(({end}) div {CUT})"
        one = f"substring(get(k, cast({first} as int)), ({start}) % {CUT} + 1, ({end}) - ({start}))"
        inner = f"array_join(slice(k, cast({first} as int) + 2, cast({last} - {first} as int) - 1), '')"
        more = f"concat(substring(get(k, cast({first} as int)), ({start}) % {CUT} + 1, {CUT}), {inner}, substring(get(k, cast({last} as int)), 1, ({end}) % {CUT}))"
        return f"if({first} = {last}, {one}, {more})"

    parts = f"transform(u, (m, i) -> concat({piece('coalesce(get(u, i - 1).end, 0)', 'm.start')}, get(array({tags}), m.kind)))"
    tail = piece("element_at(u, -1).end", "length(text)")
    clean = F.size("spans") == 0
    df = df.withColumn("_redacted", F.expr(f"if(size(spans) = 0, text, {let('k', blocks, let('u', joined, f'concat(array_join({parts}, {chr(39)}{chr(39)}), {tail})'))})"))
    text = F.when(clean, F.col("_lw_row.text")).otherwise(F.col("_redacted"))
    new = {"text": text}
    if "n_chars" in table.columns:
        new["n_chars"] = F.when(clean, F.col("_lw_row.n_chars")).otherwise(F.char_length("_redacted").cast(table.schema["n_chars"].dataType))
    return df.select(*[new[c].alias(c) if c in new else F.col(f"_lw_row.`{c}`").alias(c) for c in table.columns])


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(docs(spark, sf_dir).select("doc_id", "text")))
