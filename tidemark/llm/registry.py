"""The subpackage's queries and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, lexical_search, licenses, line_dedup, lm_scoring, media, mixing, near_dedup
from tidemark.llm import periodic_runs, quality_rules, secrets, sharding, token_store

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_media_sniffing": media.op5_media_sniffing,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_token_store": token_store.op8_token_store,
    "op9_kd_shards": sharding.op9_kd_shards,
    "op10_near_duplicates": near_dedup.op10_near_duplicates,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_secret_scan": secrets.op13_secret_scan,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op9_kd_shards": sharding.OP9_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_secret_scan": secrets.OP13_SQL,
}
