"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, clustering, decontaminate, licenses, mixing, near_dedup, quality_model, quality_rules, quotations, secrets, token_counts, token_files, vector_codes

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_quality_classifier": quality_model.op4_quality_classifier,
    "op5_rans_token_files": token_files.op5_rans_token_files,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_quotation_linking": quotations.op9_quotation_linking,
    "quoted_conversations": quotations.quoted_conversations,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_source_mix": mixing.op11_source_mix,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_centroid_clusters": clustering.op13_centroid_clusters,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op9_quotation_linking": quotations.ORACLE,
    "quoted_conversations": quotations.ORACLE_QUOTED,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
    "op11_source_mix": mixing.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_centroid_clusters": clustering.ORACLE,
}
