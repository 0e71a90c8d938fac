"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from chronofold.llm import (
    alignment,
    collocations,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    quality_fm,
    substring_dedup,
    toxicity_kn,
    url_filter,
    warc_revisit,
)


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_quality_classifier": quality_fm.op2_quality_classifier,
        "op3_warc_revisit": warc_revisit.op3_warc_revisit,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_suffix_array_dedup": substring_dedup.op5_suffix_array_dedup,
        "op6_toxicity": toxicity_kn.op6_toxicity,
        "op7_mixing_sources": mixing.op7_mixing_sources,
        "op8_language_id": language_id.op8_language_id,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_url_filters": url_filter.op10_url_filters,
        "op11_collocations": collocations.op11_collocations,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op3_warc_revisit": warc_revisit.ORACLE,
        "op4_benchmark_decontamination": decontaminate.ORACLE,
        "op7_mixing_sources": mixing.ORACLE,
        "op11_collocations": collocations.ORACLE,
        "op13_line_dedup": line_dedup.ORACLE,
    }
