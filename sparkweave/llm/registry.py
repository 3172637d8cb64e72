"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, langid, licenses, line_dedup, minhash, mixing, quality, search, secrets, simhash, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_bpe": bpe.op5_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_search": search.op11_search,
    "op12_divergence": divergence.op12_divergence,
    "op13_minhash": minhash.op13_minhash,
}

SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_secret_scan": secrets.SQL,
    "op11_search": search.SQL,
    "op12_divergence": divergence.SQL,
}
