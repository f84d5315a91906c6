"""The queries of this folder by name, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from marlstone.llm import oracles
from marlstone.llm.bpe import op1_bpe_encode_decode
from marlstone.llm.chat import op9_chat_windows
from marlstone.llm.decontaminate import op8_string_tiling
from marlstone.llm.embeddings import op7_grid_order_join
from marlstone.llm.jaccard import op4_jaccard_join
from marlstone.llm.langid import op6_language_id
from marlstone.llm.line_dedup import op10_line_dedup
from marlstone.llm.merkle import op13_merkle_manifest
from marlstone.llm.pii import op2_pii_surrogates
from marlstone.llm.rank_bpe import op12_rank_bpe
from marlstone.llm.sharding import op3_histogram_shards
from marlstone.llm.spelling import op11_spelling_variants
from marlstone.llm.substring_dedup import op5_sentence_spans

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_encode_decode, op2_pii_surrogates, op3_histogram_shards, op4_jaccard_join, op5_sentence_spans, op6_language_id,
        op7_grid_order_join, op8_string_tiling, op9_chat_windows, op10_line_dedup,
        op11_spelling_variants, op12_rank_bpe, op13_merkle_manifest,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": oracles.OP4, "op5_sentence_spans": oracles.OP5, "op7_grid_order_join": oracles.OP7, "op9_chat_windows": oracles.OP9, "op10_line_dedup": oracles.OP10,
    "op11_spelling_variants": oracles.OP11, "op13_merkle_manifest": oracles.OP13,
}
