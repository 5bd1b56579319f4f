"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from packetlens.llm import (
    chat,
    cnn,
    decontam,
    exact_dedup,
    hard_negatives,
    html_extract,
    line_dedup,
    merkle,
    packing,
    rules,
    simhash,
    suffixes,
    warc,
)

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_quality_rules": rules.op2,
    "op3_warc": warc.op3,
    "op4_simhash": simhash.op4,
    "op5_quality_classifier": cnn.op5,
    "op6_decontamination": decontam.op6,
    "op7_html_extraction": html_extract.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_chat_formatting": chat.op9,
    "op10_suffix_dedup": suffixes.op10,
    "op11_exact_dedup": exact_dedup.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_hard_negatives": hard_negatives.op13,
    "rule_ablations": rules.rule_ablations,
}

ORACLE_SQL = {
    "op2_quality_rules": rules.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
    "op10_suffix_dedup": suffixes.OP10_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
    "rule_ablations": rules.RULE_ABLATIONS_SQL,
}
