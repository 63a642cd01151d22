"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from reckon.llm.bpe import op2_bpe
from reckon.llm.classifier import op10_classifier
from reckon.llm.collocations import OP11_SQL, op11_collocations
from reckon.llm.lengths import op3_token_counts
from reckon.llm.licenses import op13_licenses
from reckon.llm.mixing import op8_mixture
from reckon.llm.near import op4_near_duplicates
from reckon.llm.quality_rules import op1_quality_rules
from reckon.llm.repeats import op9_repeats
from reckon.llm.secrets import op6_secrets
from reckon.llm.spelling import op12_spelling
from reckon.llm.topk import OP7_SQL, op7_top_k
from reckon.llm.urls import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_url_filter": op5_url_filter,
    "op6_secrets": op6_secrets,
    "op7_top_k": op7_top_k,
    "op8_mixture": op8_mixture,
    "op9_repeats": op9_repeats,
    "op10_classifier": op10_classifier,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_licenses": op13_licenses,
}

SQL: dict[str, str] = {"op5_url_filter": OP5_SQL, "op7_top_k": OP7_SQL, "op11_collocations": OP11_SQL}
