"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, lattice, media, minhash, mixing, packing, pii, quality, sharding, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_media": media.op2_media,
    "op3_chat": chat.op3_chat,
    "op4_pii": pii.op4_pii,
    "op5_lattice": lattice.op5_lattice,
    "op6_minhash": minhash.op6_minhash,
    "op7_sharding": sharding.op7_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
}
ORACLE_SQL = {"op1_mixing": mixing.OP1_SQL, "op3_chat": chat.OP3_SQL, "op5_lattice": lattice.OP5_SQL, "op6_minhash": minhash.OP6_SQL, "op7_sharding": sharding.OP7_SQL}
