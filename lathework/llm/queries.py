"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import fingerprints, langid, licences, merkle, mixing, nearcopies, neighbours, packing, private, sharding, topk, toxicity, turns

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_shards": sharding.op2_shards,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_langid": langid.op4_langid,
    "op5_fingerprint": fingerprints.op5_fingerprint,
    "op6_licences": licences.op6_licences,
    "op7_mix": mixing.op7_mix,
    "op8_near_copies": nearcopies.op8_near_copies,
    "op9_private": private.op9_private,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_topk": topk.op11_topk,
    "op12_turns": turns.op12_turns,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {"op2_shards": sharding.OP2_SQL, "op7_mix": mixing.OP7_SQL, "op8_near_copies": nearcopies.OP8_SQL, "op11_topk": topk.OP11_SQL, "op12_turns": turns.OP12_SQL, "op13_merkle": merkle.OP13_SQL}
