"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from . import ann, bpe, fim, kmeans, langid, lcp, mixing, neardup, quality, shards, tokencount, urls, warc

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_fingerprints": lcp.op2,
    "op3_token_counts": tokencount.op3,
    "op4_nearest_neighbours": ann.op4,
    "op5_byte_bpe": bpe.op5,
    "op6_near_duplicates": neardup.op6,
    "op7_url_filter": urls.op7,
    "op8_mix_sources": mixing.op8,
    "op9_warc": warc.op9,
    "op10_quality": quality.op10,
    "op11_centroids": kmeans.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_shards": shards.op13,
}
ORACLES = {
    "op7_url_filter": urls.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_centroids": kmeans.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_shards": shards.OP13_SQL,
}
