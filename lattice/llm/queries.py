"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.substring_dedup import passages

    return passages(table(spark, sf_dir, "documents"), min_words=30, identity=0.8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.flac import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=75)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), similarity=0.9).select("doc_id", "n_lines", "n_removed", "text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.periodic_runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattice.llm.whitening import whitened_rows

    return whitened_rows(table(spark, sf_dir, "embeddings"), top=16)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattice.llm.byte_bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_flac": op7_flac,
        "op8_decontamination": op8_decontamination,
        "op10_line_dedup": op10_line_dedup,
        "op9_token_files": op9_token_files,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_byte_bpe": op13_byte_bpe,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from lattice.llm import decontaminate

    return {"op8_decontamination": decontaminate.ORACLE}
