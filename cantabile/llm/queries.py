"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from cantabile.llm import bpe, decontaminate, exact_dedup, fill_middle, hard_negatives, jaccard_join, language, line_dedup, quality, secrets, sharding, token_files, warc
from cantabile.llm.oracles import EXACT_DEDUP, FILL_MIDDLE, HARD_NEGATIVES, JACCARD_JOIN, LINE_DEDUP, WARC, secrets_sql, sharding_sql

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality": quality.op3_quality,
    "op4_language": language.op4_language,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_warc": warc.op9_warc,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_secrets": secrets.op12_secrets,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLES = {
    "op2_sharding": sharding_sql(),
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_line_dedup": LINE_DEDUP,
    "op8_jaccard_join": JACCARD_JOIN,
    "op9_warc": WARC,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_secrets": secrets_sql(),
    "op13_fill_in_middle": FILL_MIDDLE,
}
