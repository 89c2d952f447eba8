"""The queries of the corpus operators, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import tables


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.partenum import similar_documents

    return similar_documents(tables(spark, sf_dir, "documents"), percent=70, n=3)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.token_store import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(tables(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1, length=1024))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.media import encode_media

    return encode_media(tables(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.bytebpe import encode_documents

    return encode_documents(tables(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.secrets import scan_documents

    return scan_documents(tables(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.langid import identify_documents

    return identify_documents(tables(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import score_documents

    return score_documents(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import judge_documents

    return judge_documents(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack_documents

    return pack_documents(tables(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.templates import drop_lines

    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs, counts=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_store": op2_token_store,
    "op3_media": op3_media,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {}
