"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from dealgraph.llm import brown, decontaminate, langid, lexical, media, mixing, near_dedup, quality, secrets, sharding, spelling, substring_dedup, warc

QUERIES = {
    "op1_quality": quality.op1,
    "op2_language": langid.op2,
    "op3_media_columns": media.op3,
    "op4_class_lm": brown.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_near_duplicates": near_dedup.op6,
    "op7_substring_dedup": substring_dedup.op7,
    "op8_mix_sources": mixing.op8,
    "op9_kd_shards": sharding.op9,
    "op10_scan_secrets": secrets.op10,
    "op11_warc": warc.op11,
    "op12_ranked_search": lexical.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES = {
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_scan_secrets": secrets.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_ranked_search": lexical.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
