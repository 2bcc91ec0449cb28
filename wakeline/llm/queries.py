"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .chat import OP5_SQL, op5_chat
from .counts import op9_token_counts
from .fingerprints import GROUPS_SQL, op6_fingerprints, similar_documents
from .licenses import OP8_SQL, op8_licenses
from .media import op7_media
from .mixing import OP1_SQL, op1_mixing
from .neardup import OP3_SQL, op3_near_duplicates
from .tokenstore import op2_token_store
from .toxicity import op10_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_store": op2_token_store,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat": op5_chat,
    "op6_fingerprints": op6_fingerprints,
    "op7_media": op7_media,
    "op8_licenses": op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "similar_documents": similar_documents,
}

ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op5_chat": OP5_SQL,
    "op8_licenses": OP8_SQL,
    "similar_documents": GROUPS_SQL,
}
