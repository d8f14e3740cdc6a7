"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkcohort.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.line_dedup import line_duplicates

    return line_duplicates(table(spark, sf_dir, "documents"), protect=0)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.cotraining import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.quality_rules import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkcohort.llm.suffix_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring": op2_substring,
        "op3_line_dedup": op3_line_dedup,
        "op4_chat": op4_chat,
        "op5_packing": op5_packing,
        "op6_cotraining": op6_cotraining,
        "op7_personal_data": op7_personal_data,
        "op8_quality_rules": op8_quality_rules,
        "op9_decontamination": op9_decontamination,
        "op10_suffix_lm": op10_suffix_lm,
    }


def oracle_sql() -> dict[str, str]:
    from sparkcohort.llm import chat

    return {"op4_chat": chat.ORACLE}
