"""Queries of this package for the driver, and their DuckDB SQL where SQL can express them."""

from tamarind.llm import ann, lines, media, mil, nbest, packing, pfor, sharding, simhash, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_balanced_sharding": sharding.op3_balanced_sharding,
    "op4_media_tiles": media.op4_media_tiles,
    "op5_url_rules": url_filter.op5_url_rules,
    "op6_nbest_pieces": nbest.op6_nbest_pieces,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_token_blocks": pfor.op8_token_blocks,
    "op9_quality_attention": mil.op9_quality_attention,
    "op10_ivf_pq": ann.op10_ivf_pq,
}

ORACLES: dict[str, str] = {
    "op5_url_rules": url_filter.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL,
}
