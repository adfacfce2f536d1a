"""Queries and SQL of the corpus operators, for the registry at the repository top."""

from __future__ import annotations

from fieldloom.llm import crf_quality, decontaminate, license_scan, mixing, quality_rules, sharding, simhash, substring_index, suffix_array, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_crf_quality": crf_quality.op2_crf_quality,
    "op3_suffix_array": suffix_array.op3_suffix_array,
    "op4_warc": warc.op4_warc,
    "op5_substring_index": substring_index.op5_substring_index,
    "op6_license_scan": license_scan.op6_license_scan,
    "op6_license_phrases": license_scan.op6_license_phrases,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_mixing": mixing.op10_mixing,
}
#: SQL of those that it can express; the others draw coins, iterate or read mark-up, and tests hold them against brute force.
ORACLE_SQL = {
    "op1_sharding": sharding.SQL,
    "op3_suffix_array": suffix_array.SQL,
    "op5_substring_index": substring_index.SQL,
    "op6_license_scan": license_scan.SQL,
    "op6_license_phrases": license_scan.PHRASES_SQL,
    "op7_quality_rules": quality_rules.SQL,
}
