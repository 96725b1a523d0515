"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from casewright.llm import chat_format, decontaminate, hard_negatives, html_extract, language_id, pitman_yor, sentencepiece_scan, simhash, source_mix, suffix_dedup, toxicity, turn_repair, weighted_fingerprint

QUERIES = {
    "op1_html_extraction": html_extract.query,
    "op2_toxicity": toxicity.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_language_id": language_id.query,
    "op5_simhash": simhash.query,
    "op6_chat_formatting": chat_format.query,
    "op7_sentencepiece": sentencepiece_scan.query,
    "op8_decontamination": decontaminate.query,
    "op9_fingerprints": weighted_fingerprint.query,
    "op10_pitman_yor": pitman_yor.query,
    "op11_source_mix": source_mix.query,
    "op12_turn_repair": turn_repair.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLES: dict[str, str] = {"op11_source_mix": source_mix.ORACLE, "op12_turn_repair": turn_repair.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
