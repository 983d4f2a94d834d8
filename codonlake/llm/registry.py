"""Queries of the training-data operators, by name, and the SQL that DuckDB runs for those that SQL can express."""

from __future__ import annotations

from codonlake.llm import chat, decontaminate, exact_dedup, language, lexical, licenses, minmax_dedup, mixing, negatives, pieces, repeats, secrets, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_secret_scan": secrets.query,
    "op3_license_scan": licenses.query,
    "op4_decontaminate": decontaminate.query,
    "op5_language_id": language.query,
    "op6_weighted_mix": mixing.query,
    "op7_minmax_dedup": minmax_dedup.query,
    "op8_chat_format": chat.query,
    "op9_run_length_dedup": repeats.query,
    "op10_warc_revisits": warc.query,
    "op11_ranked_search": lexical.query,
    "op12_hard_negatives": negatives.query,
    "op13_sentencepiece": pieces.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_secret_scan": secrets.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op6_weighted_mix": mixing.ORACLE,
    "op7_minmax_dedup": minmax_dedup.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op9_run_length_dedup": repeats.ORACLE,
    "op10_warc_revisits": warc.ORACLE,
    "op11_ranked_search": lexical.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
