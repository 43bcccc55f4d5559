"""One query per training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.llm import alignment, fingerprints, html_text, licences, line_dedup, mixing, packing, quality, repeats, simhash, tokens, warc, whitening
from roadpulse.llm.common import tables


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(tables(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(tables(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(tables(spark, sf_dir, "documents"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal(tables(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(tables(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.byte_bpe_digests(tables(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(tables(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op4_rows(tables(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tables(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(tables(spark, sf_dir, "embeddings"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer(tables(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_best_fit_packing, op3_html_text, op4_line_dedup, op5_warc, op6_fingerprints, op7_simhash,
        op8_repeated_bytes, op9_licence_scan, op10_byte_bpe, op11_whitening, op12_cross_tokenizer, op13_mixing,
    )
}
