"""Bounded, repeatable samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model is fitted on: crc32(doc_id as text) mod 4 is 2. Null ids are not held out, but never sampled."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y) of at most per_class rows of each label 0 and 1 not held out, those of least hash; conflicting labels of a row count as the lesser."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(17))
    return rows.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("y = 1").orderBy(order, "doc_id").limit(per_class))


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Rows of label 0 and 1 that are not held out."""
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out())
    r = rows.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).head()
    return r.a, r.b


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y); the sample is bounded by its parameter, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
