"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pairlens.llm import (
    learned_partitions,
    line_edits,
    mixing,
    order_minhash,
    packing,
    recompression,
    resampling,
    source_audit,
    syncmers,
    token_alignment,
    toxicity,
    url_rules,
    zip_archives,
)


def queries():
    return {
        "op1_order_minhash": order_minhash.op1_order_minhash,
        "op2_recompression": recompression.op2_recompression,
        "op3_importance_resampling": resampling.op3_importance_resampling,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_learned_partitions": learned_partitions.op5_learned_partitions,
        "op6_syncmers": syncmers.op6_syncmers,
        "op7_pack": packing.op7_pack,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_line_edits": line_edits.op9_line_edits,
        "op10_url_rules": url_rules.op10_url_rules,
        "op11_source_audit": source_audit.op11_source_audit,
        "op12_zip_archives": zip_archives.op12_zip_archives,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql():
    return {
        "op4_mix_sources": mixing.ORACLE,
        "op10_url_rules": url_rules.ORACLE,
        "op11_source_audit": source_audit.ORACLE,
        "op12_zip_archives": zip_archives.ORACLE,
    }
