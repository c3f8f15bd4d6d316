"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, bpe, decontamination, lm_scoring, ngram_join, secrets, substring_dedup, toxicity, url_filters, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_secrets": secrets.op5_secrets,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_ann": ann.op9_ann,
    "op10_url_filters": url_filters.op10_url_filters,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_ann": ann.OP9_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
}
