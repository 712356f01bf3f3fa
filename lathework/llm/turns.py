"""Operator 12: repair of conversation structure by prefix-doubling path ranking.

A conversation's rows, in order, become symbols: the initial of the role and what
is wrong with the row. A repair is a walk through an automaton of four states (nothing
yet, after system, after user, after assistant) that keeps, rewrites or deletes every
row and inserts turns between them. Four steps find the cheapest, and of the cheapest
the one whose audit (its edits' initials) is least:

1. *Places.* Rows are numbered by ranges (``common.numbered``) and cut into blocks of
   ``BLOCK`` rows, so that no task holds a whole conversation. A row that repeats an earlier
   one is found from the least place of every (conversation, role, text), by digest.
2. *Cost.* A dynamic program runs backward over (row, state) nodes. Where a conversation
   has several blocks, each gives its least costs from state to state, and these matrices are
   multiplied in the (min, +) sense by doubling, so that every block knows what its
   last states cost to the end.
3. *Audit.* The optimal arcs make a graph in which an edit's initial leaves a node once at
   most, so that an audit from a node names one path. Nodes are ranked by their next initial,
   then by the next 2, 4, 8, ... initials: a node's rank of twice the length is that of (its
   rank, the rank of the node its pointer leads to), and the pointer doubles too. The pointer of
   a node follows its least arc; a path of 2^k initials is read by k doublings. Blocks
   are joined in the same way: each maps its four entry states to exit states, and these maps
   are composed by doubling.
4. *Text.* Rows and audits stream, sorted, through the digest of the repaired text.
   SHA-256 is serial by definition: one conversation's text passes through one task, row
   by row, in bounded memory; all other work on a hot conversation is spread.

Cases: null conv_id is a conversation of its own; nulls are read as one space (a null turn in
the hash of the damage only: in the order it comes first); an empty role has no initial and can
only be rewritten or deleted; rows of one turn are ordered by the digest of role and text; a conversation
whose rows are all dropped has zeros, an empty audit and the digest of the empty text; places,
gaps and costs are longs, and a gap beyond them is null; an empty table gives an empty result;
more columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, numbered, portable, scratch, store
from .merkle import CRC

BLOCK = 4096
#: Nodes of one graph.
NODES = 1 << 20
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant; where an inserted
#: or rewritten turn leads, and what is left to insert at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
END_COST = (0, 2 * INSERT, INSERT, 0)
END_AUDIT = ("", "II", "I", "")
FAR = 1 << 60
LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: A symbol is initial + 4 * fault; initials are other, system, user, assistant.
FINE, CUT, GONE = range(3)
#: State after keeping a turn of an initial, or -1.
KEEP = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Initials of two turns that may follow each other.
FOLLOW = np.zeros((4, 4), bool)
FOLLOW[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost to the end from every (block, row, state). Blocks are right aligned:
    one with fewer rows than columns has its first in column ``columns - length``."""
    blocks, rows = codes.shape
    out = np.full((blocks, rows + 1, 4), FAR, np.int64)
    out[:, rows] = end
    for t in range(rows - 1, -1, -1):
        after, initial, fault = out[:, t + 1], codes[:, t] % 4, codes[:, t] // 4
        here = after + DELETE
        extra = np.where(fault == CUT, TRUNCATED, 0)
        stays = np.where(fault == GONE, FAR, 0)
        for state in range(4):
            kept = KEEP[state][initial]
            keep = np.where(kept >= 0, np.take_along_axis(after, np.maximum(kept, 0)[:, None], 1)[:, 0], FAR)
            rerole = after[:, NEXT[state]] + REROLE
            here[:, state] = np.minimum(here[:, state], np.minimum(keep, rerole) + extra + stays)
        user, assistant = here[:, USER].copy(), here[:, ASSISTANT].copy()
        here[:, USER] = np.minimum(user, assistant + INSERT)
        here[:, ASSISTANT] = np.minimum(assistant, user + INSERT)
        here[:, :USER] = np.minimum(here[:, :USER], here[:, USER, None] + INSERT)
        out[:, t] = np.minimum(here, FAR)
    return out


def arcs(codes: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every node, by letter: whether that edit is optimal, that is its price and the cost
    of where it leads make up the node's cost, and the node it leads to. A node is
    ((block * (rows + 1)) + row) * 4 + state."""
    blocks, rows = codes.shape
    here, after = cost[:, :-1], cost[:, 1:]
    initial, fault = codes % 4, codes // 4
    extra, open_ = np.where(fault == CUT, TRUNCATED, 0)[..., None], (fault != GONE)[..., None]
    base = (np.arange(blocks)[:, None, None] * (rows + 1) + np.arange(rows)[None, :, None]) * 4
    kept = KEEP.T[initial]
    to = np.maximum(kept, 0)
    edits = (  # as in LETTERS
        (after + DELETE == here, base + 4 + np.arange(4)),
        (here[..., NEXT] + INSERT == here, base + NEXT),
        (open_ & (kept >= 0) & (np.take_along_axis(after, to, 2) + extra == here), base + 4 + to),
        (open_ & (after[..., NEXT] + REROLE + extra == here), base + 4 + NEXT),
    )
    optimal = np.zeros((len(edits), blocks, rows + 1, 4), bool)
    target = np.zeros(optimal.shape, np.int64)
    for i, (is_optimal, leads) in enumerate(edits):
        optimal[i, :, :-1], target[i, :, :-1] = is_optimal & (here < FAR), leads
    return optimal.reshape(len(edits), -1), target.reshape(len(edits), -1)


def ranked(optimal: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(letter, rank, pointers): each node's next letter (0 at its end), its rank among
    all nodes by the whole audit, and where its least audit is after 1, 2, 4, ... letters."""
    ends = ~optimal.any(axis=0)
    least = optimal.argmax(axis=0)  # the first in ASCII order; no two arcs of a node share a letter
    letter = np.where(ends, 0, LETTERS[least]).astype(np.uint8)
    pointers = [np.where(ends, np.arange(len(ends)), np.take_along_axis(target, least[None], 0)[0])]
    rank = np.unique(letter, return_inverse=True)[1].astype(np.int64)
    while not ends[pointers[-1]].all():
        ahead = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)[1].astype(np.int64)
        pointers.append(ahead[ahead])
    return letter, rank, pointers


def audits(letter: np.ndarray, rank: np.ndarray, pointers: list[np.ndarray], first: np.ndarray) -> list[str]:
    """Least audit of each node of ``first``; nodes of one rank have the same, which is read once."""
    _, one, each = np.unique(rank[first], return_index=True, return_inverse=True)
    at = first[one][:, None]
    for ahead in pointers:
        at = np.concatenate([at, ahead[at]], axis=1)
    read = [x.tobytes().rstrip(b"\0").decode() for x in letter[at]]
    return [read[i] for i in each]


Solved = tuple[list[int], list[str], list[int]]


def solve(blocks: list[np.ndarray], ends: np.ndarray) -> list[Solved]:
    """For each block of symbols and costs of its end states: cost, least audit and exit
    state from each of the four entry states. Blocks of like length share a graph."""
    out: list = [None] * len(blocks)
    lengths = np.array([len(b) for b in blocks])
    order, low = np.argsort(lengths, kind="stable"), 0
    while low < len(order):
        rows, high = int(lengths[order[low]]), low
        while high < len(order) and lengths[order[high]] <= max(16, 2 * rows) and (high - low + 1) * (lengths[order[high]] + 1) * 4 <= max(NODES, 4 * (lengths[order[low]] + 1)):
            high += 1
        own, wide = order[low:high], int(lengths[order[high - 1]])
        codes = np.zeros((len(own), wide), np.int64)
        for i, b in enumerate(own):
            codes[i, wide - lengths[b] :] = blocks[b]
        cost = costs(codes, ends[own])
        letter, rank, pointers = ranked(*arcs(codes, cost))
        first = ((np.arange(len(own)) * (wide + 1) + wide - lengths[own])[:, None] * 4 + np.arange(4)).ravel()
        read, total, exits = audits(letter, rank, pointers, first), cost.reshape(-1)[first].tolist(), (pointers[-1][first] % 4).tolist()
        for i, b in enumerate(own):
            four = slice(4 * i, 4 * i + 4)
            out[b] = (total[four], read[four], exits[four])
        low = high
    return out


def matrix(block: np.ndarray) -> list[int]:
    """Least cost from every entry state to every exit state, row by row."""
    ends = np.full((4, 4), FAR)
    np.fill_diagonal(ends, 0)
    codes = np.broadcast_to(block, (4, len(block)))
    return costs(codes, ends)[:, 0].T.ravel().tolist()


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``table`` with every twentieth of the rows, by the
    crc32 of their names, dropped, emptied, cut, repeated or given to the user."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    out = table.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return out.drop("copy")


def coded(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, code, same): ``table`` with a row's initial and fault, bar
    repeats, and the digest of its role and text."""
    role = F.substring("role", 1, 1)
    initial = F.when(role == "s", SYSTEM).when(role == "u", USER).when(role == "a", ASSISTANT).otherwise(0)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", GONE).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    return table.select("conv_id", "turn", "role", "text", (initial + 4 * fault).alias("code"), same.alias("same"))


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, code, same, pos, n) of coded rows, in order of turn, then digest."""
    return numbered(rows.select("conv_id", "turn", "code", "same"), ["conv_id"], ["turn", "same"], "places")


def blocked(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, last, begin, codes, firsts, follow): turn and digest of a block's first
    row, all its codes, the places in it of rows that repeat no earlier one, and the code of
    the row after it."""
    here = ["conv_id", F.floor(F.col("pos") / block).alias("block"), F.pmod("pos", F.lit(block)).cast("int").alias("place")]
    firsts = rows.groupBy("conv_id", "same").agg(F.min("pos").alias("pos"))
    own = rows.select(*here, "code", F.floor((F.col("n") - 1) / block).alias("last"), F.struct("turn", "same").alias("begin"))
    first = firsts.select(*here).withColumnRenamed("place", "first")
    edge = rows.filter((F.col("pos") % block == 0) & (F.col("pos") > 0)).select("conv_id", (F.floor(F.col("pos") / block) - 1).alias("block"), F.col("code").alias("follow"))
    every = own.unionByName(first, True).unionByName(edge, True)
    return every.groupBy("conv_id", "block").agg(
        F.max("last").alias("last"), F.max(F.when(F.col("place") == 0, F.col("begin"))).alias("begin"), F.transform(F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("place", "code")))), lambda x: x["code"]).alias("codes"),
        F.collect_list("first").alias("firsts"), F.max("follow").alias("follow"),
    )


def marked(codes: list[int], firsts: list[int]) -> tuple[np.ndarray, list[int]]:
    """Symbols of a block and its blank, repeated and truncated rows."""
    symbols, repeat = np.array(codes, np.int64), np.ones(len(codes), bool)
    repeat[np.asarray(firsts, np.int64)] = False
    blank = symbols // 4 == GONE
    repeat &= ~blank
    symbols[repeat] = symbols[repeat] % 4 + 4 * GONE
    return symbols, [int(blank.sum()), int(repeat.sum()), int((symbols // 4 == CUT).sum())]


def _matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame({"row": part["row"], "m": [matrix(marked(c, f)[0]) for c, f in zip(part["codes"], part["firsts"], strict=True)]})


def _solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        found = [marked(c, f) for c, f in zip(part["codes"], part["firsts"], strict=True)]
        blocks = [x for x, _ in found]
        illegal = []
        for b, follow in zip(blocks, part["follow"], strict=True):
            initials = np.append(b % 4, int(follow) % 4) if follow == follow and follow is not None else b % 4
            illegal.append(int((~FOLLOW[initials[:-1], initials[1:]]).sum()))
        done = solve(blocks, np.array(part["end"].to_list(), np.int64))
        yield pd.DataFrame({
            "row": part["row"], "blank": [n[0] for _, n in found], "duplicate": [n[1] for _, n in found], "truncated": [n[2] for _, n in found],
            "illegal": illegal, "costs": [x[0] for x in done], "audits": [x[1] for x in done], "exits": [x[2] for x in done],
        })


def _product(a: str, b: str) -> Column:
    """(min, +) product of two matrices of 16 longs."""
    four = F.array(*map(F.lit, range(4)))
    at = lambda m, i, j: F.get(F.col(m), i * 4 + j)
    return F.flatten(F.transform(four, lambda i: F.transform(four, lambda j: F.least(F.lit(FAR), F.array_min(F.transform(four, lambda k: at(a, i, k) + at(b, k, j)))))))


def _doubled(blocks: DataFrame, column: str, join: Column, way: int, rounds: int) -> DataFrame:
    """Joins ``column`` of every block with those of all blocks after (``way`` 1) or
    before it (-1) by doubling: a round takes in as many blocks as all rounds before."""
    for k in range(rounds):
        other = blocks.select(F.col("conv_id").alias("_c"), (F.col("block") - way * (1 << k)).alias("_b"), F.col(column).alias("_other"))
        on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
        both = blocks.join(other, on, "left").withColumn(column, F.when(F.col("_other").isNull(), F.col(column)).otherwise(join))
        blocks = store(both.drop("_c", "_b", "_other"), "doubled")
    return blocks


def _next_to(blocks: DataFrame, column: str, way: int, out: str) -> DataFrame:
    other = blocks.select(F.col("conv_id").alias("_c"), (F.col("block") - way).alias("_b"), F.col(column).alias(out))
    return blocks.join(other, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left").drop("_c", "_b")


def repairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, begin, blank, duplicate, truncated, illegal, cost, audit) of every block
    of ``placed`` rows; ``begin`` is turn and digest of its first one. ``cost`` is its conversation's in
    block 0 and 0 in others; audits of a conversation's blocks make up its own."""
    blocks = store(blocked(rows, block).withColumn("row", F.expr("uuid()")), "blocks")
    most = blocks.agg(F.max("last")).first()[0] or 0
    rounds = int(most).bit_length()
    end = F.array(*[F.lit(x).cast("long") for x in END_COST])
    if rounds:
        long = blocks.filter("last > 0")
        costs_ = long.select("row", "codes", "firsts").mapInPandas(_matrices, "row string, m array<long>")
        scanned = _doubled(store(long.select("conv_id", "block", "row").join(costs_, "row"), "matrices"), "m", _product("m", "_other"), 1, rounds)
        to_end = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.array_min(F.zip_with(F.slice("m", i * 4 + 1, 4), F.lit(end), lambda x, y: x + y)))
        ends = _next_to(scanned.withColumn("to_end", to_end), "to_end", 1, "end").select("row", "end")
        blocks_in = blocks.join(ends, "row", "left").withColumn("end", F.coalesce("end", end))
    else:
        blocks_in = blocks.withColumn("end", end)
    schema = "row string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>, exits array<int>"
    solved = blocks_in.select("row", "codes", "firsts", "follow", "end").mapInPandas(_solved, schema)
    solved = store(blocks.select("conv_id", "block", "last", "begin", "row").join(solved, "row"), "solved")
    entry = F.lit(START)
    if rounds:
        maps = solved.filter("last > 0").select("conv_id", "block", "row", F.col("exits").alias("to"))
        after = F.transform("_other", lambda x: F.get("to", x))
        entries = _next_to(_doubled(store(maps, "maps"), "to", after, -1, rounds), "to", -1, "before")
        solved = solved.join(entries.select("row", F.get("before", F.lit(START)).alias("entry")), "row", "left")
        entry = F.coalesce("entry", F.lit(START))
    tail = F.when(F.col("block") == F.col("last"), F.get(F.array(*map(F.lit, END_AUDIT)), F.get("exits", entry))).otherwise("")
    audit = F.concat(F.get("audits", entry), tail)
    cost = F.when(F.col("block") == 0, F.get("costs", F.lit(START))).otherwise(F.lit(0).cast("long"))
    return solved.select("conv_id", "block", "begin", "blank", "duplicate", "truncated", "illegal", cost.alias("cost"), audit.alias("audit"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str]]:
    """Repaired turns (conversation, role, text) of rows in order, where a block's audit comes
    before its first row. A conversation ends with a null role.

    Among rows alike in turn, role and text, audits come first: letters wait for their rows."""
    none = object()
    now, state, edits = none, START, deque()

    def ended() -> Iterator[tuple[object, str | None, str]]:
        nonlocal state
        for _ in range(len(edits)):
            edits.popleft()
            state = NEXT[state]
            yield now, ROLES[state], ""
        if now is not none:
            yield now, None, ""

    for batch in batches:
        for conv, role, text, audit in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")], strict=True):
            if audit is not None:
                if conv != now:
                    yield from ended()
                    now, state = conv, START
                edits.extend(audit)
                continue
            while (edit := edits.popleft()) == "I":
                state = NEXT[state]
                yield now, ROLES[state], ""
            if edit == "K":
                state = KEEP[state][INITIALS.get(role[:1], 0)]
                yield now, role, text
            elif edit == "R":
                state = NEXT[state]
                yield now, ROLES[state], text
    yield from ended()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, found, digest, begun = [], [], hashlib.sha256(), False
    for conv, role, text in _turns(batches):
        if role is None:
            ids.append(conv)
            found.append(digest.hexdigest())
            digest, begun = hashlib.sha256(), False
        else:
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
        if len(ids) >= BLOCK:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": found})
            ids, found = [], []
    yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "repaired_sha256": pa.array(found, pa.string())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, place = [], 0
    for conv, role, text in _turns(batches):
        if role is None:
            place = 0
            continue
        out.append((conv, place, role, text))
        place += 1
        if len(out) >= BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _streamed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Texts and audits, sorted: texts are shuffled here and nowhere else."""
    none = F.lit(None).cast("string")
    own = rows.select("conv_id", "turn", "same", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "role", "text", none.alias("audit"))
    heads = blocks.select("conv_id", "begin.turn", "begin.same", F.lit(0).alias("kind"), "block", none.alias("role"), none.alias("text"), "audit")
    both = own.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "same", "kind", "block")
    return both.select("conv_id", "role", "text", "audit")


def repair(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, role, text): the conversations of ``table`` (conv_id, turn, role, text,
    no nulls in the last two) after the cheapest repair."""
    rows = store(coded(table), "turns")
    blocks = store(repairs(placed(rows), block), "repairs")
    return _streamed(rows, blocks).mapInArrow(_rows, "conv_id long, place long, role string, text string")


def report(table: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for every conversation of ``ids``: faults, gaps, cost, audit and the digest of
    the repaired conversation. All facts meet in one aggregation."""
    rows = store(coded(table), "turns")
    blocks = store(repairs(placed(rows), block), "repairs")
    turns = rows.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("*").alias("distinct"))
    gaps = F.try_add(F.try_subtract("high", "low"), F.lit(1).cast("long")) - F.col("distinct")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    digests = _streamed(rows, blocks).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    facts = ids.select("conv_id").distinct()
    for more in (turns.select("conv_id", gaps.alias("gaps"), F.col("high").alias("has_turns")), blocks.drop("begin"), digests):
        facts = facts.unionByName(more, True)
    part = F.when(F.col("audit").isNotNull(), F.struct("block", "audit"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["audit"]), "")
    gap = F.when(F.max("has_turns").isNull(), F.lit(0).cast("long")).otherwise(F.max("gaps"))
    digest = F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest()))
    return facts.groupBy("conv_id").agg(gap.alias("gaps"), *sums, audit.alias("audit"), digest.alias("repaired_sha256"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults and its cheapest repair."""
    table = docs(spark, sf_dir, "conversations")
    with scratch(spark):
        return store(report(damaged(table), table), "report", lasting=True)


#: Steps of up to two insertions and one edit of a row: states before and after,
#: insertions, initial that is kept (null: any role), edit and price.
_STEPS = """
 SELECT * FROM (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) i(s, mid, ins)
 JOIN (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0),
  (0, NULL, 2, 'R', 3), (1, NULL, 2, 'R', 3), (2, NULL, 3, 'R', 3), (3, NULL, 2, 'R', 3), (0, NULL, 0, 'D', 4), (1, NULL, 1, 'D', 4), (2, NULL, 2, 'D', 4), (3, NULL, 3, 'D', 4)) e(mid, initial, t, edit, price) USING (mid)"""

_NAME = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

OP12_SQL = rf"""
WITH RECURSIVE kinds AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(({CRC.format(_NAME)})::BIGINT, 4294967295) % 20 AS kind FROM conversations),
hurt AS (
 SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos,
  regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending FROM hurt),
judged AS (
 SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
facts AS (
 SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
steps AS ({_STEPS}),
costs AS (
 SELECT conv_id, n AS pos, s, {{'cost': c, 'audit': a}} AS best FROM facts, (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')) e(s, c, a)
 UNION ALL
 SELECT c.conv_id, c.pos - 1, p.s, min({{'cost': (c.best.cost + 3 * length(p.ins) + p.price + CASE WHEN j.fault = 'truncated' AND p.edit <> 'D' THEN 3 ELSE 0 END)::INTEGER, 'audit': p.ins || p.edit || c.best.audit}})
 FROM costs c JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.pos = c.pos
 JOIN steps p ON p.t = c.s AND (p.initial IS NULL OR p.initial = j.initial) AND (p.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
 GROUP BY c.conv_id, c.pos, p.s),
walk AS (
 SELECT conv_id, best.audit AS todo, 0::BIGINT AS done, 0 AS s, '' AS said FROM costs WHERE pos = 0 AND s = 0
 UNION ALL
 SELECT w.conv_id, w.todo[2:], w.done + CASE WHEN w.todo[1] = 'I' THEN 0 ELSE 1 END, CASE w.todo[1] WHEN 'D' THEN w.s WHEN 'K' THEN CASE j.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE w.s WHEN 2 THEN 3 ELSE 2 END END,
  w.said || CASE w.todo[1] WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text ELSE chr(10) || CASE w.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE w.todo[1] WHEN 'R' THEN j.text ELSE '' END END
 FROM walk w LEFT JOIN judged j ON w.todo[1] <> 'I' AND j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.done + 1 WHERE w.todo <> '')
SELECT i.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
 coalesce(f.illegal, 0) AS illegal, coalesce(c.best.cost, 0)::BIGINT AS cost, coalesce(c.best.audit, '') AS audit, sha256(coalesce(w.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN costs c ON f.n IS NOT NULL AND c.conv_id IS NOT DISTINCT FROM i.conv_id AND c.pos = 0 AND c.s = 0
LEFT JOIN walk w ON f.n IS NOT NULL AND w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.todo = ''
"""

portable(__name__)
