"""The registered queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import align, ann, capfilters, convrepair, html, linededup, lm, minhash, packing, quality, repair, spm, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_sentencepiece": spm.op2_sentencepiece,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_nearest": ann.op4_nearest,
    "op5_main_text": html.op5_main_text,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_pitman_yor": lm.op9_pitman_yor,
    "op10_repair_ids": repair.op10_repair_ids,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_embedding_duplicates": capfilters.op12_embedding_duplicates,
    "op13_conversation_repair": convrepair.op13_conversation_repair,
}
SQL: dict[str, str] = {
    "op3_line_dedup": linededup.OP3_SQL,
    "op6_exact_topk": topk.OP6_SQL,
    "op12_embedding_duplicates": capfilters.OP12_SQL,
}
