"""The registered queries of this subpackage."""

from __future__ import annotations

from folioforge.llm import sql
from folioforge.llm.collocations import op12_collocations
from folioforge.llm.language_id import op6_language_id
from folioforge.llm.manifest import op13_merkle_manifest
from folioforge.llm.ngram_lm import op1_lm_score
from folioforge.llm.packing import op4_best_fit_packing
from folioforge.llm.passages import op7_substring_dedup
from folioforge.llm.quality_classifier import op2_quality_classifier
from folioforge.llm.quality_rules import op10_quality_rules
from folioforge.llm.secret_scan import op9_secret_scan
from folioforge.llm.simhash import op5_simhash
from folioforge.llm.tokens import op8_bpe
from folioforge.llm.vector_search import OP3_SQL, op3_ball_tree_topk
from folioforge.llm.winnowing import op11_winnowing

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ball_tree_topk": op3_ball_tree_topk,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_winnowing": op11_winnowing,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op3_ball_tree_topk": OP3_SQL,
    "op9_secret_scan": sql.secret_scan(),
    "op10_quality_rules": sql.quality_rules(),
    "op12_collocations": sql.collocations(),
    "op13_merkle_manifest": sql.merkle_manifest(),
}
