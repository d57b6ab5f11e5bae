"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from quire.llm import (
    byte_bpe,
    decontamination,
    embedding_dedup,
    html_extract,
    merkle,
    ngram_join,
    packing,
    quality,
    token_counts,
    token_records,
    toxicity,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_packing": packing.op4_packing,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_token_records": token_records.op8_token_records,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
