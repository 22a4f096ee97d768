"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import balanced_sharding, curve_packing, jaccard_join, line_crf, line_dedup, norm_search, odd_minhash, pii, quality_knn, soft_mixing, tool_calls, vector_codes, vp_search

MODULES = [quality_knn, curve_packing, tool_calls, soft_mixing, jaccard_join, line_crf, balanced_sharding, vp_search, line_dedup, pii, odd_minhash, norm_search, vector_codes]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
