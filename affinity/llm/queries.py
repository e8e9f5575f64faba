"""The queries of this package, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from affinity.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from affinity.llm.decontamination import op4_decontamination
from affinity.llm.line_dedup import OP5_SQL, op5_line_dedup
from affinity.llm.lm_scoring import op2_lm_scoring
from affinity.llm.nearest import op6_nearest_neighbours
from affinity.llm.packing import op8_best_fit_packing
from affinity.llm.personal_data import op7_personal_data
from affinity.llm.quality import op9_quality_classifier
from affinity.llm.ranked_search import OP12_SQL, op12_ranked_search
from affinity.llm.sentencepieces import op11_sentencepiece
from affinity.llm.sharding import op3_sharding
from affinity.llm.simhash_dedup import op1_simhash_dedup
from affinity.llm.substring_dedup import op10_substring_dedup

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_personal_data": op7_personal_data,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL over the same tables; the other queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
