"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op01_shards, op02_langid, op03_toxicity, op04_jaccard, op05_html, op06_topk, op07_mix, op08_media, op09_pack, op10_pii


def queries() -> dict:
    return {
        "op1_hash_tree_shards": op01_shards.op1_hash_tree_shards,
        "op2_string_kernel_langid": op02_langid.op2_string_kernel_langid,
        "op3_noisy_channel_toxicity": op03_toxicity.op3_noisy_channel_toxicity,
        "op4_adaptive_prefix_jaccard": op04_jaccard.op4_adaptive_prefix_jaccard,
        "op5_tag_path_extract": op05_html.op5_tag_path_extract,
        "op6_nra_topk": op06_topk.op6_nra_topk,
        "op7_fair_queue_mix": op07_mix.op7_fair_queue_mix,
        "op8_avi_media": op08_media.op8_avi_media,
        "op9_config_lp_pack": op09_pack.op9_config_lp_pack,
        "op10_surrogate_pii": op10_pii.op10_surrogate_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_nra_topk": op06_topk.ORACLE, "op7_fair_queue_mix": op07_mix.ORACLE}
