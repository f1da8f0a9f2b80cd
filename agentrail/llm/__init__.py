"""Training-data operators: deduplication, filtering, mixing, packing and
token output over tables of documents.  ``QUERIES`` and ``ORACLES`` hold the
registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark import cloudpickle

from . import (alignment, chat_format, common, fingerprints, jaccard_join, language_id, line_dedup, mixing, packing, quality_rules,
               spelling, token_counts, token_files, tokens, toxicity)

# Functions that run in Python workers are shipped by value: executors need
# no installed copy of this package.
for _module in (alignment, chat_format, common, fingerprints, jaccard_join, language_id, packing, spelling, token_counts, token_files, tokens,
                toxicity):
    cloudpickle.register_pickle_by_value(_module)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_packing": packing.op3_packing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_token_files": token_files.op7_token_files,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_language_id": language_id.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_alignment": alignment.op12_alignment,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
