"""Queries and SQL of this subpackage, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import bitsliced, bpe, licenses, linededup, lm, mixing, nearcopies, packing, telephony, tokenids, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": mixing.op1_mix,
    "op2_token_ids": tokenids.op2_token_ids,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_pack": packing.op6_pack,
    "op7_near_copies": nearcopies.op7_near_copies,
    "op8_media": telephony.op8_media,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_lm": lm.op10_lm,
    "op11_lexical_search": bitsliced.op11_lexical_search,
    "op12_byte_bpe": bpe.op12_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_mix": mixing.op1_sql(),
    "op4_line_dedup": linededup.OP4_SQL,
    "op5_license_scan": licenses.op5_sql(),
    "op9_exact_topk": topk.OP9_SQL,
    "op11_lexical_search": bitsliced.OP11_SQL,
}
