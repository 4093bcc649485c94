"""The registered queries of the text operators, over their whole tables, and
DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import (decontamination, langid, licenses, mixing, negatives, prefix_trie, quality, revisits, secrets,
                         simhash, substrings, token_counts, toxicity)
from marquee.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: operator(*[table(spark, sf_dir, n) for n in names])


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": _on(licenses.scan, "documents"),
        "op2_language_id": _on(langid.identify, "documents"),
        "op3_warc_revisits": _on(revisits.report, "pages"),
        "op4_secret_scan": _on(secrets.report, "documents"),
        "op5_token_counts": _on(token_counts.count_tokens, "documents"),
        "op6_toxicity": _on(toxicity.score, "documents", "labels"),
        "op7_decontamination": _on(decontamination.report, "documents", "benchmark"),
        "op8_quality_rules": _on(quality.judged, "documents"),
        "op9_simhash": _on(simhash.report, "documents"),
        "op10_mixing": _on(mixing.report, "documents", "labels"),
        "op11_hard_negatives": negatives.report,
        "op12_substring_dedup": _on(substrings.report, "documents"),
        "op13_prefix_trie": prefix_trie.report,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisits": revisits.ORACLE, "op11_hard_negatives": negatives.ORACLE,
            "op12_substring_dedup": substrings.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
