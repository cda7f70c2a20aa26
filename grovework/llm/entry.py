"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, language, mixing, neighbours, periodic, scoring, secret_scan, sharding, simhash, spelling, substring_dedup


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_simhash": simhash.op2_simhash,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_secrets": secret_scan.op4_secrets,
        "op5_neighbours": neighbours.op5_neighbours,
        "op6_chat": chat.op6_chat,
        "op7_language": language.op7_language,
        "op8_mixing": mixing.op8_mixing,
        "op9_scoring": scoring.op9_scoring,
        "op10_sharding": sharding.op10_sharding,
        "op11_spelling": spelling.op11_spelling,
        "op12_periodic": periodic.op12_periodic,
        "op13_jaccard": jaccard.op13_jaccard,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op6_chat": chat.OP6_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op10_sharding": sharding.OP10_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op12_periodic": periodic.OP12_SQL,
        "op13_jaccard": jaccard.OP13_SQL,
    }
