"""Queries and SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from waygraph.llm import bpe, decontaminate, hilbert, htmltext, pii, secrets, simhash, suffix_dedup, topk, toxicity


def queries() -> dict:
    return {
        "op1_bwt_merge_dedup": suffix_dedup.op1_bwt_merge_dedup,
        "op2_simhash_pigeonhole": simhash.op2_simhash_pigeonhole,
        "op3_toxicity_chain": toxicity.op3_toxicity_chain,
        "op4_secret_ownership": secrets.op4_secret_ownership,
        "op5_histogram_topk": topk.op5_histogram_topk,
        "op6_hilbert_sharding": hilbert.op6_hilbert_sharding,
        "op7_pii_boosting": pii.op7_pii_boosting,
        "op8_bpe_automaton": bpe.op8_bpe_automaton,
        "op9_rare_seed_alignment": decontaminate.op9_rare_seed_alignment,
        "op10_max_subsequence": htmltext.op10_max_subsequence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_ownership": secrets.oracle(), "op5_histogram_topk": topk.ORACLE}
