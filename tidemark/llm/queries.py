"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from tidemark.llm import (
    op1_token_counts,
    op2_perplexity,
    op3_toxicity,
    op4_mixture,
    op5_hmm,
    op6_warc,
    op7_ngram_jaccard,
    op8_packed_ids,
    op9_secrets,
    op10_decontaminate,
    op11_repeats,
    op12_collocations,
    op13_orchard,
)

LLM_QUERIES = {
    "op1_token_counts": op1_token_counts.query,
    "op2_perplexity": op2_perplexity.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_mixture": op4_mixture.query,
    "op5_hmm": op5_hmm.query,
    "op6_warc": op6_warc.query,
    "op7_ngram_jaccard": op7_ngram_jaccard.query,
    "op8_packed_ids": op8_packed_ids.query,
    "op9_secrets": op9_secrets.query,
    "op10_decontaminate": op10_decontaminate.query,
    "op11_repeats": op11_repeats.query,
    "op12_collocations": op12_collocations.query,
    "op13_orchard": op13_orchard.query,
}
