"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .compact_windows import op7_compact_windows
from .conversation_trie import OP13_SQL, op13_conversation_trie
from .decontamination import op10_decontamination
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op2_language_id
from .media import op3_media
from .mixing import OP9_SQL, op9_mixing
from .ngram_join import OP8_SQL, op8_ngram_join
from .quality import op6_quality
from .sharding import op5_sharding
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op1_toxicity
from .url_filter import OP12_SQL, op12_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_media": op3_media,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_compact_windows": op7_compact_windows,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL = {"op8_ngram_join": OP8_SQL, "op9_mixing": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_url_filter": OP12_SQL, "op13_conversation_trie": OP13_SQL}
