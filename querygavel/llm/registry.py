"""Registered queries of the subpackage, each with the SQL it is checked by (None where SQL cannot express it)."""

from __future__ import annotations

from querygavel.llm.byte_bpe import round_trip
from querygavel.llm.chat_masks import CHATS_SQL, formatted_conversations
from querygavel.llm.exact_dedup import EXACT_SQL, exact_copies
from querygavel.llm.hard_negatives import MINED_SQL, mined
from querygavel.llm.kd_topk import NEAREST_SQL, nearest
from querygavel.llm.licenses import license_scan
from querygavel.llm.merkle import MANIFEST_SQL, checked_manifest
from querygavel.llm.packing import packed_documents
from querygavel.llm.rans import token_files
from querygavel.llm.resharding import shards_by_bytes
from querygavel.llm.suffix_dedup import passages_removed
from querygavel.llm.super_minhash import near_copies
from querygavel.llm.toxicity import toxicity_scores

LLM = {
    "op1_flow_resharding": (shards_by_bytes, None),
    "op2_kd_topk": (nearest, NEAREST_SQL),
    "op3_compression_toxicity": (toxicity_scores, None),
    "op4_rans_tokens": (token_files, None),
    "op5_grace_dedup": (exact_copies, EXACT_SQL),
    "op6_suffix_dedup": (passages_removed, None),
    "op7_lp_packing": (packed_documents, None),
    "op8_super_minhash": (near_copies, None),
    "op9_byte_bpe": (round_trip, None),
    "op10_license_rules": (license_scan, None),
    "op11_chat_masks": (formatted_conversations, CHATS_SQL),
    "op12_merkle_manifest": (checked_manifest, MANIFEST_SQL),
    "op13_segment_negatives": (mined, MINED_SQL),
}
