"""Queries and SQL of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from weftlake.llm import bpe, exact_dedup, language, licenses, lm, near_dedup, packing, quality, secrets, sharding

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_licenses": licenses.op2,
    "op3_near_dedup": near_dedup.op3,
    "op4_secret_scan": secrets.op4,
    "op5_bpe": bpe.op5,
    "op6_sharding": sharding.op6,
    "op7_quality": quality.op7,
    "op8_lm": lm.op8,
    "op9_packing": packing.op9,
    "op10_language": language.op10,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_near_dedup": near_dedup.OP3_SQL,
    "op4_secret_scan": secrets.OP4_SQL,
    "op7_quality": quality.OP7_SQL,
}
