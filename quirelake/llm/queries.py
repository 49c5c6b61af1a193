"""The training-data operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, language_model, line_dedup, merkle, mixing, near_dedup, quality_classifier, quality_rules, sharding, token_output, toxicity, trie, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op1_line_dedup_pairs": line_dedup.op1_line_dedup_pairs,
    "op2_sharding": sharding.op2_sharding,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_output": token_output.op5_token_output,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_warc": warc.op11_warc,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op1_line_dedup_pairs": line_dedup.PAIRS_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_prefix_trie": trie.ORACLE_SQL,
}
