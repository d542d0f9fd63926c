"""The queries of this package and their DuckDB oracles."""

from helixframe.llm import bpe, collocations, licenses, line_dedup, near_dedup, packing, prefix_trie, quality, secrets, sharding, simhash, substring, webp

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_attention_quality": quality.op2_attention_quality,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_bpe_round_trip": bpe.op4_bpe_round_trip,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_license_digests": licenses.op6_license_digests,
    "op7_lossless_webp": webp.op7_lossless_webp,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_lpt_shards": sharding.op9_lpt_shards,
    "op10_simhash": simhash.op10_simhash,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_best_first_phrases": collocations.op12_best_first_phrases,
    "op13_relative_lz": substring.op13_relative_lz,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op6_license_digests": licenses.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_best_first_phrases": collocations.ORACLE,
    "op13_relative_lz": substring.ORACLE,
}
