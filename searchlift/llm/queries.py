"""The numbered queries and the SQL of those that SQL can state."""

from __future__ import annotations

from searchlift.llm import conversation_repair, decontamination, elkan, exact_dedup, html_text, language_id, mixing, near_dedup, pii, sharding, syncmers, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_histogram_shards": sharding.op1,
        "op2_minhash_near_dedup": near_dedup.op2,
        "op3_source_mix": mixing.op3,
        "op4_toxicity": toxicity.op4,
        "op5_pii": pii.op5,
        "op6_main_text": html_text.op6,
        "op7_exact_dedup": exact_dedup.op7,
        "op8_language_id": language_id.op8,
        "op9_decontamination": decontamination.op9,
        "op10_token_counts": token_counts.op10,
        "op11_syncmer_fingerprints": syncmers.op11,
        "op12_elkan_clusters": elkan.op12,
        "op13_conversation_repair": conversation_repair.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.ORACLE_OP7, "op12_elkan_clusters": elkan.ORACLE_OP12, "op13_conversation_repair": conversation_repair.ORACLE_OP13}
