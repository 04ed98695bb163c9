"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from boardflow.llm.byte_bpe import op8_padded_bpe
from boardflow.llm.embedding_dedup import OP7_SQL, op7_pivot_cells
from boardflow.llm.fill_middle import OP13_SQL, op13_isolated_split
from boardflow.llm.fingerprint import op6_lookup_sketches
from boardflow.llm.jaccard_join import op1_grouped_prefixes
from boardflow.llm.language_id import op3_language_masks
from boardflow.llm.line_dedup import OP10_SQL, op10_line_windows
from boardflow.llm.packing import op4_pattern_packing
from boardflow.llm.prefix_trie import OP12_SQL, op12_merged_prefixes
from boardflow.llm.sentence_pieces import op11_backtracked_pieces
from boardflow.llm.sharding import OP9_SQL, op9_stratified_shards
from boardflow.llm.suffix_dedup import OP5_SQL, op5_suffix_shards
from boardflow.llm.warc import OP2_SQL, op2_chunked_records

QUERIES = {
    f.__name__: f
    for f in (
        op1_grouped_prefixes,
        op2_chunked_records,
        op3_language_masks,
        op4_pattern_packing,
        op5_suffix_shards,
        op6_lookup_sketches,
        op7_pivot_cells,
        op8_padded_bpe,
        op9_stratified_shards,
        op10_line_windows,
        op11_backtracked_pieces,
        op12_merged_prefixes,
        op13_isolated_split,
    )
}

ORACLE_SQL = {
    "op2_chunked_records": OP2_SQL,
    "op5_suffix_shards": OP5_SQL,
    "op7_pivot_cells": OP7_SQL,
    "op9_stratified_shards": OP9_SQL,
    "op10_line_windows": OP10_SQL,
    "op12_merged_prefixes": OP12_SQL,
    "op13_isolated_split": OP13_SQL,
}
