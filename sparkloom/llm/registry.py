"""The queries of this package and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import licenses, lm, mixing, pieces, pii, quality, simhash, topk, toxicity, urls


def queries():
    found = (
        urls.op1_url_filters,
        lm.op2_lm_scoring,
        licenses.op3_license_scans,
        mixing.op4_mixing,
        toxicity.op5_toxicity,
        pii.op6_pii,
        topk.op7_exact_topk,
        quality.op8_quality_rules,
        pieces.op9_sentencepiece,
        simhash.op10_simhash_near_dedup,
    )
    return {q.__name__: q for q in found}


def oracle_sql():
    return {"op3_license_scans": licenses.sql(), "op4_mixing": mixing.OP4_SQL, "op7_exact_topk": topk.SQL}
