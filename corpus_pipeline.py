"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronq.llm import jaccard, nbsvm, ordinal, packing, substring_dedup
from heronq.llm.common import settle, table

#: Production parameters.
QUALITY_SCORE = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
REPEAT_WORDS = 20

#: The last stage has no SQL form.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    Null and empty texts have no features and go or stay by the model's intercept; null ids, sources and languages, repeated rows and
    extra columns change nothing; very long texts are read whole; no rows give no rows.
    """
    return nbsvm.accepted(docs, table(spark, sf_dir, "labels"), threshold=QUALITY_SCORE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of expected toxic grade.

    Null and empty texts are judged by the thresholds alone; the rest is as for the classifier.
    """
    return ordinal.harmless(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar documents, that of smallest doc_id; of repeated rows one.

    Null ids come after all others, and rows are told apart by id and text. Texts without words, null ones too, are similar to none and
    stay. Extra columns may have any names; no rows give no rows.
    """
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand earlier in the corpus; n_chars follows the text.

    Null texts become empty; of rows with equal ids neither is earlier, null ids are one id after all others; extra columns stay;
    very long texts are cut like others; no rows give no rows.
    """
    cut = substring_dedup.without_repeats(docs, REPEAT_WORDS)
    return cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows with the corpus' mixture of sources.

    Null texts are the end id alone, null sources the queue ""; repeated rows are packed again; extra columns go; no rows give no pieces.
    """
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
