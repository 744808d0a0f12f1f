"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: Query name, module of this subpackage, function there.
_QUERIES = {
    "op1_quality_divergence": ("quality", "op1"),
    "op2_jaccard_join": ("jaccard", "op2"),
    "op3_fuzzy_lines": ("lines", "op3"),
    "op4_semi_markov_pii": ("pii", "op4"),
    "op5_warc_derivatives": ("warc", "op5"),
    "op6_mix_sources": ("mixing", "op6"),
    "op7_rlz_substrings": ("rlz", "op7"),
    "op8_interval_repeats": ("repeats", "op8"),
    "op9_png_media": ("png", "op9"),
    "op10_best_fit_packing": ("packing", "op10"),
    "op11_phrase_collocations": ("phrases", "op11"),
    "op12_golay_simhash": ("simhash", "op12"),
    "op13_merkle_manifest": ("manifest", "op13"),
}


def _lazy(module: str, name: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"epochweave.llm.{module}"), name)(spark, sf_dir)


def queries() -> dict:
    return {k: _lazy(*v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from epochweave.llm import manifest, mixing, phrases, quality

    return {"op1_quality_divergence": quality.SQL, "op6_mix_sources": mixing.SQL, "op11_phrase_collocations": phrases.SQL, "op13_merkle_manifest": manifest.SQL}
