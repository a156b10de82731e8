"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_collapse, hamming_topk
from .chat_collapse import op4_chat_collapse
from .hamming_topk import op3_hamming_topk
from .jaccard_join import op6_jaccard_join
from .packing import op2_packing
from .phrase_dedup import op10_phrase_dedup
from .plane_files import op1_plane_files
from .prefix_bpe import op7_prefix_bpe
from .quality_rules import op8_quality_rules
from .secret_scan import op5_secret_scan
from .trie_counts import op9_trie_counts

QUERIES = {
    "op1_plane_files": op1_plane_files,
    "op2_packing": op2_packing,
    "op3_hamming_topk": op3_hamming_topk,
    "op4_chat_collapse": op4_chat_collapse,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_trie_counts": op9_trie_counts,
    "op10_phrase_dedup": op10_phrase_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_hamming_topk": hamming_topk.ORACLE,
    "op4_chat_collapse": chat_collapse.ORACLE,
}
