"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spelunka.llm import ann, bpe, langid, lines, media, mixing, simhash, substring, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": media.op1_media,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_bpe": bpe.op3_bpe,
        "op4_langid": langid.op4_langid,
        "op5_substring": substring.op5_substring,
        "op6_ann": ann.op6_ann,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_warc": warc.op9_warc,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring": substring.ORACLE, "op7_line_dedup": lines.ORACLE, "op8_mixing": mixing.ORACLE, "op9_warc": warc.ORACLE}
