"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from agoraflow.llm import bpe, brown, decontaminate, divergence, extract, jaccard, repair, sharding, toxicity, warc

QUERIES = {
    "op1_brown": brown.query,
    "op2_text_density": extract.query,
    "op3_fold_bpe": bpe.query,
    "op4_virtual_slots": sharding.query,
    "op5_divergence": divergence.query,
    "op6_compression": toxicity.query,
    "op7_salvage_warc": warc.query,
    "op8_repair": repair.query,
    "op9_spaced_seeds": decontaminate.query,
    "op10_signature_trees": jaccard.query,
}

ORACLE_SQL: dict[str, str] = {
    "op7_salvage_warc": warc.SQL,
}
