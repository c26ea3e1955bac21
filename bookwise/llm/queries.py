"""The registered queries of this subpackage."""

from __future__ import annotations

from bookwise.llm.divergence import op13_divergence
from bookwise.llm.jaccard import op6_ngram_jaccard
from bookwise.llm.licenses import op2_license_scan
from bookwise.llm.mixing import op9_mixing
from bookwise.llm.packing import op5_packing
from bookwise.llm.phrases import op12_collocations
from bookwise.llm.quality_classifier import op3_quality_classifier
from bookwise.llm.quality_rules import op1_quality_rules
from bookwise.llm.sharding import op4_sharding
from bookwise.llm.simhash import op11_simhash
from bookwise.llm.tokens import op10_token_counts
from bookwise.llm.topk import op7_topk
from bookwise.llm.warc import op8_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_simhash": op11_simhash,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
}
