from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import odd_documents
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_packing import check_pieces
from tests.llm.test_substring_dedup import brute as brute_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("odd", [False, True])
def test_stages_in_order(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if odd:
        docs = odd_documents(spark).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars", "extra")
    columns = docs.columns
    made = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in docs.schema]
        made.append({r.doc_id: r for r in docs.collect()})
    quality, toxic, near, cut = made
    assert set(quality) >= set(toxic) >= set(near) == set(cut)
    groups = brute_groups({d: r.text for d, r in toxic.items()}, 5, 80)
    assert set(near) == {d for d, (_, c) in groups.items() if c == d}
    passages = brute_passages({d: r.text for d, r in near.items()}, 20)
    for d, (_, removed, kept) in passages.items():
        assert cut[d].text == (kept if removed else near[d].text or "")
        assert cut[d].n_chars == len(cut[d].text) and cut[d].lang == near[d].lang
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_pieces(pieces, {d: r.text for d, r in cut.items()})


def test_run_and_empty(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert pieces and max(Counter(r.sequence_id for r in pieces).values()) > 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_near_duplicates_by_row(spark, sf_dir):
    """Names that clash with the operator's own, null and equal ids, repeated rows: one row of each component stays, unlike texts all do."""
    base = [f"w{i}" for i in range(60)]
    edit = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    rows = [(1, edit()), (None, edit(0)), (None, "some other words of a text without id"), (None, "one more text that has no id at all")]
    rows += [(4, "four is here twice with the same text"), (4, "four is here twice with the same text"), (4, "and once with quite another text of its own")]
    rows += [(None, "two rows without id and one text"), (None, "two rows without id and one text"), (7, None), (8, ""), (9, edit(59))]
    docs = spark.createDataFrame([(*r, "en", f"s{i}", i, i, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, first_id long, name long, c0 long, text_id string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = {(1, edit()), (None, rows[2][1]), (None, rows[3][1]), (4, rows[4][1]), (4, rows[6][1]), (None, rows[7][1]), (7, None), (8, "")}
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit(1)).withColumn("kept_text", F.lit("k"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.count() <= docs.count()
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() >= docs.count()
