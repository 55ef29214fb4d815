"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op1_rules, op2_quality, op3_near, op4_replies, op5_urls, op6_decontaminate, op7_licences, op8_mixing, op9_substrings, op10_lines


def queries() -> dict:
    return {
        "op1_rules": op1_rules.op1_rules,
        "rule_ablation": op1_rules.rule_ablation,
        "op2_quality": op2_quality.op2_quality,
        "op3_near": op3_near.op3_near,
        "op4_replies": op4_replies.op4_replies,
        "op5_urls": op5_urls.op5_urls,
        "op6_decontaminate": op6_decontaminate.op6_decontaminate,
        "op7_licences": op7_licences.op7_licences,
        "op8_mixing": op8_mixing.op8_mixing,
        "op9_substrings": op9_substrings.op9_substrings,
        "op10_lines": op10_lines.op10_lines,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {
        "op1_rules": op1_rules.ORACLE,
        "rule_ablation": op1_rules.ABLATION_ORACLE,
        "op3_near": op3_near.ORACLE,
        "op4_replies": op4_replies.ORACLE,
        "op5_urls": op5_urls.ORACLE,
        "op6_decontaminate": op6_decontaminate.ORACLE,
        "op7_licences": op7_licences.ORACLE,
        "op8_mixing": op8_mixing.ORACLE,
        "op9_substrings": op9_substrings.ORACLE,
        "op10_lines": op10_lines.ORACLE,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
