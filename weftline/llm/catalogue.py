"""Every query of this subpackage by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from weftline.llm import oracle, queries_files, queries_labels, queries_near, queries_text

QUERIES = {
    "op1_toxicity": queries_labels.op1_toxicity,
    "op2_personal_data": queries_labels.op2_personal_data,
    "op3_bpe_round_trip": queries_text.op3_bpe_round_trip,
    "op4_exact_top_k": queries_near.op4_exact_top_k,
    "op5_sharding": queries_files.op5_sharding,
    "op6_warc_revisits": queries_files.op6_warc_revisits,
    "op7_imatch": queries_files.op7_imatch,
    "op8_packing": queries_text.op8_packing,
    "op9_licence_scan": queries_labels.op9_licence_scan,
    "op10_ngram_join": queries_near.op10_ngram_join,
    "op11_yinyang": queries_near.op11_yinyang,
    "op12_fill_in_middle": queries_text.op12_fill_in_middle,
    "op13_chat_format": queries_text.op13_chat_format,
}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
