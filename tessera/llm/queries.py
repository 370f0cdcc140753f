"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tessera.llm import html, langid, media, mixing, neardup, packing, quality, secrets, sharding, substrings

QUERIES = {
    "op1_bm25_packing": packing.op1_bm25_packing,
    "op2_mpeg_audio": media.op2_mpeg_audio,
    "op3_debruijn_dedup": substrings.op3_debruijn_dedup,
    "op4_quality_ratio": quality.op4_quality_ratio,
    "op5_pareto_mix": mixing.op5_pareto_mix,
    "op6_langid_ftrl": langid.op6_langid_ftrl,
    "op7_superminhash_dedup": neardup.op7_superminhash_dedup,
    "op8_mincut_html": html.op8_mincut_html,
    "op9_secret_forest": secrets.op9_secret_forest,
    "op10_hash_tree_shards": sharding.op10_hash_tree_shards,
}
SQL = {
    "op4_quality_ratio": quality.OP4_SQL,
    "op5_pareto_mix": mixing.OP5_SQL,
    "op10_hash_tree_shards": sharding.OP10_SQL,
}
