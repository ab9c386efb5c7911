"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import ORACLE as CHAT_ORACLE
from .chat import op3_chat_format
from .fingerprint import ORACLE as FINGERPRINT_ORACLE
from .fingerprint import op5_fingerprint
from .mixing import op1_mix_sources
from .near_dup import ORACLE as NEAR_DUP_ORACLE
from .near_dup import op7_near_duplicates
from .packing import op2_pack
from .rollup import op8_token_counts
from .tokenfile import op9_token_file
from .topk import ORACLE as TOP_K_ORACLE
from .topk import op4_top_k
from .toxicity import op10_toxicity
from .urls import ORACLE as URL_ORACLE
from .urls import op6_url_filter

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pack": op2_pack,
    "op3_chat_format": op3_chat_format,
    "op4_top_k": op4_top_k,
    "op5_fingerprint": op5_fingerprint,
    "op6_url_filter": op6_url_filter,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_token_file": op9_token_file,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": CHAT_ORACLE,
    "op4_top_k": TOP_K_ORACLE,
    "op5_fingerprint": FINGERPRINT_ORACLE,
    "op6_url_filter": URL_ORACLE,
    "op7_near_duplicates": NEAR_DUP_ORACLE,
}
