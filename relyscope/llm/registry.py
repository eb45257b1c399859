"""The thirteen queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import infill, jaccard, language, linededup, mixing, packing, periodic, quality, sharding, substrings, topk, toxicity, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_language_id": language.op2_language_id,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": urls.op4_url_filter,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_pack_sequences": packing.op6_pack_sequences,
    "op7_shards": sharding.op7_shards,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_exact_top_k": topk.op9_exact_top_k,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_substring_dedup": substrings.op12_substring_dedup,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op9_exact_top_k": topk.OP9_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_substring_dedup": substrings.OP12_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
