"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, importance, language_id, line_dedup, lm_score, packing, prefix_trie, quality, sharding, simhash_dedup, token_files, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        decontaminate.op2_decontaminate,
        embedding_dedup.op3_embedding_dedup,
        simhash_dedup.op4_simhash_dedup,
        url_filter.op5_url_filter,
        sharding.op6_sharding,
        lm_score.op7_lm_score,
        packing.op8_packing,
        line_dedup.op9_line_dedup,
        quality.op10_quality,
        token_files.op11_token_files,
        importance.op12_importance_resampling,
        prefix_trie.op13_prefix_trie,
    )
}
ORACLES = {
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
