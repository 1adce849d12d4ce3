"""Benchmark overlap against plain sets of runs."""

import re
from collections import Counter

import pytest

from heronq.operators.overlap import bloom_filter, coverage_of_items, found_runs, overlap_of_documents, run_index
from tests.odd import TEXTS

PASSAGE = "every good item has a passage that others Like to copy from it"


def runs(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


@pytest.fixture(scope="module")
def tables(spark):
    items = [(1, PASSAGE), (1, PASSAGE), (2, "short one"), (3, None), (None, PASSAGE + " and then some more words of its own"), (5, "w " * 30), (6, "not in any text " * 3)]
    docs = [(3 * i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    docs += [(100, "before " + PASSAGE.upper() + " after"), (100, "x " + PASSAGE + " " + PASSAGE), (101, PASSAGE[9:60]), (101, PASSAGE[9:60])]
    docs += [(200 + i, f"a{i} " + PASSAGE + f" b{i}") for i in range(300)]  # a run of most rows
    make = lambda rows, key: spark.createDataFrame([(*r, "x", 1, 2) for r in rows], f"{key} long, text string, run string, n_runs int, doc_row int")
    return docs, items, make(docs, "doc_id"), make(items, "item_id")


@pytest.mark.parametrize("most", [1 << 20, 8])
@pytest.mark.parametrize("n", [2, 5])
def test_against_sets(tables, n, most):
    docs, items, d, i = tables
    known = {r for _, t in items for r in runs(t, n)}
    want = Counter()
    for doc_id, text in docs:
        have = runs(text, n)
        hits = sum(r in known for r in have)
        want[doc_id, len(have), hits, hits / len(have) if have else None] += 1
    assert Counter(tuple(r) for r in overlap_of_documents(d, i, n, most).collect()) == want
    all_runs = {r for _, t in docs for r in runs(t, n)}
    want = Counter()
    for item_id, text in items:
        have = set(runs(text, n))
        want[item_id, len(have), len(have & all_runs), len(have & all_runs) / len(have) if have else None] += 1
    assert Counter(tuple(r) for r in coverage_of_items(d, i, n, most).collect()) == want


def test_empty_tables(tables):
    docs, items, d, i = tables
    assert overlap_of_documents(d.limit(0), i).count() == 0 and coverage_of_items(d, i.limit(0)).count() == 0
    assert overlap_of_documents(d, i.limit(0)).agg({"n_hits": "sum"}).head()[0] == 0
    assert coverage_of_items(d.limit(0), i).agg({"n_found": "sum"}).head()[0] == 0


def test_filter_prunes_and_has_a_bound(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    index = run_index(items, 8).where("run is not null")
    assert bloom_filter(index, 64) is None
    bits, mask = bloom_filter(index, 1 << 20)
    assert len(bits.head()["bits"]) == (mask + 1) // 64
    some, every = (found_runs(docs, index, 8, most).where("run is not null").count() for most in (1 << 20, 64))
    true = found_runs(docs, index, 8, 64).join(index.select("run").distinct(), "run").count()
    assert true <= some <= true + 0.02 * every
