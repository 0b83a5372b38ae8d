"""Queries of the corpus operators, as registered by the repository's entry module."""

from __future__ import annotations

from . import factors, fingerprints, lines, losses, mixing, neardups, neighbours, sentences, suffixes, toxicity

QUERIES = {
    "op1_near_dedup": neardups.query,
    "op2_sentencepiece": sentences.query,
    "op3_mixing": mixing.query,
    "op4_fingerprints": fingerprints.query,
    "op5_line_dedup": lines.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_substring_dedup": factors.query,
    "op8_lm_scoring": losses.query,
    "op9_neighbours": neighbours.query,
    "op10_toxicity": toxicity.query,
}

ORACLES = {
    "op3_mixing": mixing.ORACLE,
    "op5_line_dedup": lines.ORACLE,
}
