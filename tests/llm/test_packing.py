import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from heronq.llm import packing, queries
from tests.llm.cases import ODD_TEXTS, odd_documents

FILE = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("totals, shares", [([1000, 10, 300], [0.5, 0.1, 0.4]), ([7], [1.0]), ([5000, 5000, 1, 64], [0.05, 0.9, 0.01, 0.04]), ([0, 900], [0.5, 0.5])])
def test_closed_form_equals_deficits_kept_round_by_round(totals, shares):
    s = packing.Schedule(totals, shares, window=64, slot=16)
    order = packing.simulate(totals, s.credit.tolist(), s.cost, 16)
    queue, slot = (np.array(x, np.int64) for x in zip(*order))
    assert s.rank(queue, slot).tolist() == list(range(len(order)))
    sizes = [min(16, totals[q] - 16 * k) for q, k in order]
    assert s.place(queue, slot).tolist() == (np.cumsum(sizes) - sizes).tolist()
    for q in range(len(totals)):
        assert ((s.deficit(q, np.arange(50)) >= 0) & (s.deficit(q, np.arange(50)) < s.cost)).all()


def check_pieces(rows, texts, window=packing.WINDOW):
    library = Tokenizer.from_file(FILE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.asarray(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, some in by_sequence.items():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (k == len(by_sequence) - 1 and at < window)


def test_query_and_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op7_packing(spark, sf_dir).collect()
    check_pieces(rows, {r.doc_id: r.text for r in docs.collect()})
    total = {}
    for r in rows:
        total[r.queue] = total.get(r.queue, 0) + r.length
    whole = sum(total.values())
    windows = max(r.sequence_id for r in rows)
    for upto in (windows // 3, windows // 2, windows * 3 // 4):  # every prefix of windows has the target mixture
        for q, n in total.items():
            got = sum(r.length for r in rows if r.queue == q and r.sequence_id < upto)
            assert abs(got - upto * packing.WINDOW * n / whole) <= packing.WINDOW


def test_odd_rows_targets_and_many_sources(spark):
    from pyspark.sql import functions as F

    docs = odd_documents(spark)
    texts = {i * 3: t for i, t in enumerate(ODD_TEXTS)}
    for kw in ({}, {"targets": {"s": 0.9, "": 0.1}}, {"max_queues": 1}, {"window": 64, "slot": 16}):
        got = packing.pack(docs, FILE, **kw).withColumn("ids_crc32", F.crc32("ids"))
        check_pieces(got.collect(), texts, kw.get("window", packing.WINDOW))
    assert packing.pack(docs.limit(0), FILE).count() == 0
    made = packing.sequences(packing.pack(docs, FILE), pad_id=0).collect()
    assert all(len(r.ids) == 4 * packing.WINDOW or bin(r.used).count("1") == 1 for r in made)


def test_more_sources_than_fit_in_memory_keep_queues_and_targets(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i * 7 % 90)), str(i % 70) if i % 2 else "big") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ordered = lambda df: sorted((r.queue, r.sequence_id, r.offset, r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    for targets in (None, {"5": 0.5, "big": 0.2, "no such source": 0.3}):
        in_memory = ordered(packing.pack(docs, FILE, targets=targets, window=64, slot=16, max_queues=1000))
        assert {r[0] for r in in_memory} == {r[2] for r in rows}
        assert ordered(packing.pack(docs, FILE, targets=targets, window=64, slot=16, max_queues=3)) == in_memory


def test_seventy_sources_by_name(spark):
    docs = spark.createDataFrame([(i, "some words " * 40, f"source {i % 70}") for i in range(210)], "doc_id long, text string, source string")
    got = packing.pack(docs, FILE, targets={"source 5": 0.5}, window=64, slot=16).collect()
    assert {r.queue for r in got} == {f"source {i}" for i in range(70)}
    last = max(r.sequence_id for r in got if r.queue == "source 5")
    assert last < max(r.sequence_id for r in got) / 10  # half of each window until it is empty


@pytest.mark.parametrize("targets, max_queues", [(None, 64), ({"a": 0.5, "c": 0.125}, 64), ({"a": 0.5, "c": 0.125}, 1)])
def test_every_window_has_the_target_mixture(spark, targets, max_queues):
    """Until a source is empty, each window holds its share to a few slots, and all windows before it to one window's worth of slots."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 50)), "abcd"[i % 4]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, FILE, targets=targets, max_queues=max_queues).collect()
    total = {q: sum(r.length for r in got if r.queue == q) for q in "abcd"}
    named = targets or {}
    rest = 1 - sum(named.values())
    others = sum(n for q, n in total.items() if q not in named)
    share = {q: named.get(q, total[q] / others * rest) for q in total}
    last = min(max(r.sequence_id for r in got if r.queue == q) for q in "abcd")
    assert last >= 3
    for k in range(last):
        for q in "abcd":
            mine = sum(r.length for r in got if r.queue == q and r.sequence_id == k)
            assert abs(mine - share[q] * packing.WINDOW) <= 3 * packing.SLOT


def test_targets_that_leave_nothing(spark):
    docs = spark.createDataFrame([(i, "some words " * 40, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    got = packing.pack(docs, FILE, targets={"a": 1.0}, window=64, slot=16).collect()
    place = lambda r: (r.sequence_id, r.offset)
    assert max(place(r) for r in got if r.queue == "a") < min(place(r) for r in got if r.queue == "b")


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b", "s"), (None, "c", "s"), (3, None, None)], "doc_id long, text string, source string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in packing.pack(docs, FILE).collect()) == [("3", 1), ("None", 2), ("None", 3)]
