"""The queries of the text operators: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronq.llm import bit_sliced, codec, embedding_dedup, fim, jaccard, nbsvm, ordinal, packing, quality_rules, spelling, substring_dedup, token_files, twins, warc
from heronq.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.encode_to_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_files(manifest)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Bands of the corpus' invented prose under piece_bpe_32k, just outside those of labelled good texts.
FERTILITY_BANDS = {
    "en": quality_rules.Band((1.80, 2.60), 0.02, (6.00, 7.80), 3.25),
    "de": quality_rules.Band((1.95, 2.60), 0.02, (6.05, 7.80), 3.40),
    "fr": quality_rules.Band((1.60, 2.40), 0.02, (6.00, 7.80), 3.75),
    "es": quality_rules.Band((1.75, 2.30), 0.02, (6.05, 7.80), 3.50),
}


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), FERTILITY_BANDS)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, is_query=F.col("vec_id") % 20 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20)
    kept = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("restored"))
    return kept.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=97, least_chars=5, least_count=3, times=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_token_files, op3_quality_rules, op4_substring_dedup, op5_quality_classifier, op6_toxicity, op7_packing, op8_embedding_dedup, op9_bpe_codec, op10_warc, op11_bit_sliced_search, op12_fill_in_middle, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return dict(twins.ORACLES)
