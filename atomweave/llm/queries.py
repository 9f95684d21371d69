"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import language, mixing, neardup, pieces, pii, quality, sharding, sstable, substrings, topk

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_language": language.op2_language,
    "op3_pieces": pieces.op3_pieces,
    "op4_mixing": mixing.op4_mixing,
    "op5_neardup": neardup.op5_neardup,
    "op6_token_shards": sstable.op6_token_shards,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_substrings": substrings.op9_substrings,
    "op10_topk": topk.op10_topk,
}
#: The others hash, tokenise or learn in ways that SQL lacks; the tests hold them against brute force.
ORACLE_SQL = {"op5_neardup": neardup.ORACLE, "op9_substrings": substrings.ORACLE, "op10_topk": topk.ORACLE}
