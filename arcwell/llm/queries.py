"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from arcwell.llm.ann import op7_nearest_neighbours
from arcwell.llm.bpe import op2_bpe_round_trip
from arcwell.llm.langid import op5_language_id
from arcwell.llm.lempel_ziv import OP1_SQL, op1_substring_dedup
from arcwell.llm.mixing import op10_source_mix
from arcwell.llm.neardup_vectors import OP4_SQL, op4_embedding_near_dedup
from arcwell.llm.simhash import op8_simhash_near_dedup
from arcwell.llm.suffixes import OP3_SQL, op3_suffix_array_dedup
from arcwell.llm.toxicity import op6_toxicity
from arcwell.llm.warc import OP9_SQL, op9_warc_round_trip

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_source_mix": op10_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op4_embedding_near_dedup": OP4_SQL,
    "op9_warc_round_trip": OP9_SQL,
}
