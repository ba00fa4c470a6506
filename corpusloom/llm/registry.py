"""Queries of the subpackage, each with its SQL where SQL can express it."""

from corpusloom.llm import centroids, counts, langid, licences, mixing, neardup, ogg, pieces, pii, sharding, tokens, whitening, winnowing

QUERIES = {
    "op1_ogg_media": ogg.op1_ogg_media,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_winnowing": winnowing.op3_winnowing,
    "op4_language_profiles": langid.op4_language_profiles,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_disclosure": pii.op6_disclosure,
    "op7_minhash_dedup": neardup.op7_minhash_dedup,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_token_files": tokens.op9_token_files,
    "op10_lpt_shards": sharding.op10_lpt_shards,
    "op11_whitening": whitening.op11_whitening,
    "op12_heap_clusters": centroids.op12_heap_clusters,
    "op13_token_counts": counts.op13_token_counts,
}
ORACLE_SQL = {
    "op5_licence_scan": licences.OP5_SQL,
    "op8_source_mix": mixing.OP8_SQL,
}
