"""The registered queries of the training-data operators, one an operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import line_dedup, secret_scan, spelling, url_filter, vector_codes


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; QUARRYSTONE_TOKENIZERS names another folder."""
    folder = os.environ.get("QUARRYSTONE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"), URL_RULES)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.media import text_media

    return text_media(_read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.jaccard_join import jaccard_join

    return jaccard_join(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.toxicity import toxicity_report

    return toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.pieces import encode_pieces

    return encode_pieces(_read(spark, sf_dir, "documents"), model=tokenizer_path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.hash_forest import nearest

    return nearest(_read(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), model=tokenizer_path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_media": op2_media,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_pieces": op5_pieces,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_hash_forest": op7_hash_forest,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.oracle_sql(URL_RULES),
    "op8_secret_scan": secret_scan.oracle_sql(),
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op13_vector_codes": vector_codes.oracle_sql(),
}
