"""Names and SQL twins of the text queries."""

from __future__ import annotations

from waymark.llm import licenses, mixing, twins
from waymark.llm import queries as q


def queries():
    return {
        "op1_near_duplicates": q.op1_near_duplicates,
        "op2_media": q.op2_media,
        "op3_chat": q.op3_chat,
        "op4_mix": q.op4_mix,
        "op5_warc": q.op5_warc,
        "op6_byte_shards": q.op6_byte_shards,
        "op7_licenses": q.op7_licenses,
        "op7_license_windows": q.op7_license_windows,
        "op8_language": q.op8_language,
        "op9_token_counts": q.op9_token_counts,
        "op10_decontaminate": q.op10_decontaminate,
        "op11_periodic_runs": q.op11_periodic_runs,
        "op12_toxicity": q.op12_toxicity,
        "op13_hard_negatives": q.op13_hard_negatives,
    }


def oracle_sql():
    return {
        "op1_near_duplicates": twins.near_duplicates(),
        "op3_chat": twins.chat(),
        "op4_mix": mixing.oracle_sql(),
        "op5_warc": twins.warc(),
        "op7_licenses": licenses.oracle_sql(),
        "op11_periodic_runs": twins.periodic_runs(),
        "op13_hard_negatives": twins.hard_negatives(),
    }
