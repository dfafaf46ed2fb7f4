"""The operators' queries, and SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from . import clusters, flac, html, jaccard, langid, linefreq, lm, mixing, neardup, oracles, packing, pii, vbyte, veccodes

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_pii_sanitise": pii.op5_pii_sanitise,
    "op6_token_vbyte": vbyte.op6_token_vbyte,
    "op7_language_id": langid.op7_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_embedding_near_dedup": neardup.op9_embedding_near_dedup,
    "op10_flac_media": flac.op10_flac_media,
    "op11_centroid_clustering": clusters.op11_centroid_clustering,
    "op12_line_frequency": linefreq.op12_line_frequency,
    "op13_code_compression": veccodes.op13_code_compression,
}
ORACLES: dict[str, str] = oracles.ORACLES | {"op11_centroid_clustering": clusters.ORACLE, "op12_line_frequency": linefreq.ORACLE, "op13_code_compression": veccodes.ORACLE}
