"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import collocations, exact_topk, hilbert_ann, jaccard_join, language_id, lexical_search, mixing, near_dedup, packing, quality_fm, suffix_dedup, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality": quality_fm.op4_quality,
    "op5_hilbert_ann": hilbert_ann.op5_hilbert_ann,
    "op6_voronoi_topk": exact_topk.op6_voronoi_topk,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {"op6_voronoi_topk": exact_topk.ORACLE, "op8_mixing": mixing.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
