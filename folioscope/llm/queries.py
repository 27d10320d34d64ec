"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from .clustering import op12_clusters
from .conversations import op13_conversations
from .jaccard_join import op6_jaccard_join
from .licenses import op9_licenses
from .media import op1_media
from .minhash_dedup import op11_minhash_dedup
from .mixing import op4_mixing
from .packing import op5_packing
from .sql import OP3_SQL, OP6_SQL, OP7_SQL, OP11_SQL
from .sql_rounds import OP12_SQL, OP13_SQL
from .token_counts import op10_token_counts
from .token_files import op2_token_files
from .topk_search import op7_topk_search
from .toxicity import op8_toxicity
from .url_filter import op3_url_filter

QUERIES = {
    "op1_media": op1_media,
    "op2_token_files": op2_token_files,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_topk_search": op7_topk_search,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_token_counts": op10_token_counts,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_clusters": op12_clusters,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op7_topk_search": OP7_SQL, "op11_minhash_dedup": OP11_SQL, "op12_clusters": OP12_SQL, "op13_conversations": OP13_SQL}
