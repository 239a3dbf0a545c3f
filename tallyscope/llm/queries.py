"""The corpus queries and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tallyscope.llm.counterparts import SQL
from tallyscope.llm.conversation_repair import op13_conversation_repair
from tallyscope.llm.decontaminate import op7_decontaminate
from tallyscope.llm.embedding_dups import op12_embedding_dups
from tallyscope.llm.fill_in_middle import op11_fill_in_middle
from tallyscope.llm.jaccard import op10_jaccard_components
from tallyscope.llm.language import op3_language_id
from tallyscope.llm.packing import op8_best_fit_packing
from tallyscope.llm.quality_rules import op9_quality_rules
from tallyscope.llm.secrets import op2_secret_scan
from tallyscope.llm.shards import op6_vector_shards
from tallyscope.llm.token_counts import op5_token_counts
from tallyscope.llm.token_files import op4_token_files
from tallyscope.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_token_counts": op5_token_counts,
    "op6_vector_shards": op6_vector_shards,
    "op7_decontaminate": op7_decontaminate,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_components": op10_jaccard_components,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_embedding_dups": op12_embedding_dups,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["QUERIES", "SQL"]
