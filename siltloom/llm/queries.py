"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from siltloom.llm.centroids import op13_threshold_algorithm
from siltloom.llm.context_mixing import op11_context_mixing
from siltloom.llm.decontamination import op8_aho_corasick
from siltloom.llm.language import op1_evidence_fusion
from siltloom.llm.lines import op10_fuzzy_lines
from siltloom.llm.minhash import op9_fast_similarity_sketch
from siltloom.llm.mixing import op2_min_cost_flow
from siltloom.llm.oracles import ORACLES
from siltloom.llm.pivots import op3_pivot_permutations
from siltloom.llm.secrets import op4_multipart_credentials
from siltloom.llm.sharding import op6_histogram_sort
from siltloom.llm.substrings import op7_prefix_suffix_trees
from siltloom.llm.tokens import op5_count_only_viterbi
from siltloom.llm.whitening import op12_householder_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_evidence_fusion,
        op2_min_cost_flow,
        op3_pivot_permutations,
        op4_multipart_credentials,
        op5_count_only_viterbi,
        op6_histogram_sort,
        op7_prefix_suffix_trees,
        op8_aho_corasick,
        op9_fast_similarity_sketch,
        op10_fuzzy_lines,
        op11_context_mixing,
        op12_householder_whitening,
        op13_threshold_algorithm,
    )
}
__all__ = ["ORACLES", "QUERIES"]
