"""The registered queries of this subpackage, and the SQL twins where SQL can express them."""

from __future__ import annotations

from tripfold.llm.op1_decontamination import op1_decontamination
from tripfold.llm.op10_toxicity_counterfactual import op10_toxicity_counterfactual
from tripfold.llm.op11_spelling_variants import op11_spelling_variants
from tripfold.llm.op12_reply_trees import op12_reply_trees
from tripfold.llm.op13_cholesky_whitening import op13_cholesky_whitening
from tripfold.llm.op2_quality_mil import op2_quality_mil
from tripfold.llm.op3_improbable_digest import op3_improbable_digest
from tripfold.llm.op4_ngram_jaccard_join import op4_ngram_jaccard_join
from tripfold.llm.op5_source_mix import op5_source_mix
from tripfold.llm.op6_gru_lm import op6_gru_lm
from tripfold.llm.op7_site_lines import SQL as SITE_LINES
from tripfold.llm.op7_site_lines import op7_site_lines
from tripfold.llm.op8_html_boosted import op8_html_boosted
from tripfold.llm.op9_token_index import op9_token_index

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_mil": op2_quality_mil,
    "op3_improbable_digest": op3_improbable_digest,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_source_mix": op5_source_mix,
    "op6_gru_lm": op6_gru_lm,
    "op7_site_lines": op7_site_lines,
    "op8_html_boosted": op8_html_boosted,
    "op9_token_index": op9_token_index,
    "op10_toxicity_counterfactual": op10_toxicity_counterfactual,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_reply_trees": op12_reply_trees,
    "op13_cholesky_whitening": op13_cholesky_whitening,
}
ORACLE_SQL: dict[str, str] = {"op7_site_lines": SITE_LINES}
