"""Operator 1: best-fit packing by hierarchical residual packing.

Partitions tokenise their documents and pack the pieces best-fit, longest
first, in blocks of ``LOCAL`` pieces. Bins that are nearly full are emitted; the
others rise through a merge tree as rigid items. Every node of the tree packs
the bins of ``FAN`` children best-fit again and emits what is nearly full now, up
to the root. No bin is cut off: where more bins rise than ``NODE`` a node, there
are as many nodes as that takes, and the bins are dealt over them by hash, which
gives every node the same mix of rooms. The tree ends with the node that holds all
open bins, or when a round over several nodes joins fewer than ``GAIN`` of them,
as the bins then are too full for each other.

Cases: null text is an empty document, which is one piece, its end mark;
repeated rows and rows without id are documents of their own (ids travel as
text, as a null beside them would turn numbers into floats); an empty table
gives no sequence; more columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, portable, scratch, store

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
#: Free tokens up to which a bin counts as nearly full.
SLACK = 8
#: Children of a node of the merge tree; bins that a node holds; pieces a local pass holds.
FAN, NODE, LOCAL = 16, 50_000, 60_000
#: Share of the open bins that a round over several nodes must join for another to follow, and most rounds.
GAIN, ROUNDS = 0.02, 24
#: Long texts are tokenised in runs of about so many characters.
RUN = 1 << 16

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer(vocabulary: str = VOCABULARY):
    """text -> ids of the byte-level BPE. The vocabulary's rank file gives the
    ids of its JSON file at a quarter of the time (tested to be equal); the
    special token's string counts as that token, as the JSON file has it."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(text: str) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > RUN:  # between a word and a blank before a word, no token spans
            cut = SAFE_CUT.search(text, at + RUN)
            end = cut.start() if cut else len(text)
            out.append(np.array(coder.encode(text[at:end], allowed_special="all"), np.uint32))
            at = end
        out.append(np.array([*coder.encode(text[at:], allowed_special="all"), END], np.uint32))
        return np.concatenate(out)

    return ids


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else pieces of
    ``capacity`` with the shorter one first."""
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and its offset there.

    Bins are kept in stacks by free room; a bit set says which stacks hold any,
    so that the tightest room for an item is its lowest bit from the item's size on."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return where, offset


def tokenised(parts: Iterator[pd.DataFrame], vocabulary: str, capacity: int) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Token ids and rows of PIECES, a document at a time."""
    ids = tokenizer(vocabulary)
    for part in parts:
        for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
            own = ids(text or "")
            yield own, [(doc_id, k, s, n, zlib.crc32(own[s : s + n].astype("<u4").tobytes())) for k, (s, n) in enumerate(cut(len(own), capacity))]


def _texts(table: DataFrame) -> DataFrame:
    return table.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def pieces(table: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``with_ids`` adds their token ids."""

    def run(parts):
        for own, rows in tokenised(parts, vocabulary, capacity):
            out = pd.DataFrame(rows, columns=NAMES)
            yield out.assign(ids=[own[s : s + n].tolist() for _, _, s, n, _ in rows]) if with_ids else out

    out = _texts(table).mapInPandas(run, PIECES + (", ids array<int>" if with_ids else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast(table.schema["doc_id"].dataType))


def _packed(rows: pd.DataFrame, unit: np.ndarray, base: np.ndarray, capacity: int, first_id: int, root: bool, slack: int):
    """One best-fit round over units (pieces, or bins of pieces). ``base`` is a
    row's offset in its unit. Adds sequence_id, offset and open to ``rows``."""
    ids, unit = np.unique(unit, return_inverse=True)
    load = np.bincount(unit, weights=rows["length"]).astype(np.int64)
    where, offset = best_fit(load, capacity)
    filled = np.bincount(where, weights=load).astype(np.int64) if len(load) else np.empty(0, np.int64)
    rising = (capacity - filled > slack) & (not root)
    return rows.assign(sequence_id=first_id + where[unit], offset=offset[unit] + base, open=rising[where[unit]])


PACKED = PIECES + ", sequence_id long, offset long, open boolean"


def pack(table: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, slack: int = SLACK, node_bins: int = NODE) -> DataFrame:
    """PIECES of all documents with sequence_id and offset. Numbers of
    sequences are (round, node, bin) in one long."""

    def number(level: int, node: int, block: int = 0) -> int:
        return (level << 58) | (node << 32) | (block << 20)

    def local(parts):
        node, block, held = TaskContext.get().partitionId(), 0, []

        def done():
            rows = pd.DataFrame(held, columns=NAMES)
            return _packed(rows, np.arange(len(rows)), np.zeros(len(rows), np.int64), capacity, number(0, node, block), False, slack).assign(node=node)

        for _, own in tokenised(parts, vocabulary, capacity):
            held += own
            if len(held) >= LOCAL:
                yield done()
                held, block = [], block + 1
        if held:
            yield done()

    def merger(level: int, root: bool):
        def merge(key, rows):
            rows = rows.sort_values(["sequence_id", "offset"], kind="stable")
            got = _packed(rows[NAMES], rows["sequence_id"].to_numpy(), rows["offset"].to_numpy(), capacity, number(level, int(key[0])), root, slack)
            return got.assign(node=int(key[0]))

        return merge

    level, before, out = 0, 0, []
    now = store(_texts(table).mapInPandas(local, PACKED + ", node long"), "packed-0")
    while True:
        out.append(now.filter("not open"))
        rising = now.filter("open")
        # A bin is open as a whole, and its piece at offset 0 stands for it.
        bins, last = rising.filter("offset = 0").agg(F.count("*"), F.max("node")).first()
        if not bins:
            break
        tree = -(-(last + 1) // FAN)
        nodes = max(tree, -(-bins // node_bins))
        root = nodes == 1 or (nodes > tree and level > 0 and bins > (1 - GAIN) * before) or level == ROUNDS
        level, before = level + 1, bins
        at = F.expr(f"node div {FAN}") if nodes == tree else F.pmod(F.xxhash64("sequence_id"), F.lit(nodes))
        up = rising.withColumn("node", at)
        now = store(up.groupBy("node").applyInPandas(merger(level, root), PACKED + ", node long"), f"packed-{level}")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.drop("open", "node").withColumn("doc_id", F.col("doc_id").cast(table.schema["doc_id"].dataType))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return store(pack(docs(spark, sf_dir)), "packed", lasting=True)


portable(__name__)
