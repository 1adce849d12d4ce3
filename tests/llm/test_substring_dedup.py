import hashlib
import random

import numpy as np
import pytest

from heronq.llm import held, queries
from heronq.llm.substring_dedup import Windows, anchors, double, substring_dedup
from tests.llm.cases import ODD_TEXTS, odd_documents, python_words


def brute(texts, window):
    """{doc_id: (words, removed, kept text)}: a window repeats if its word sequence starts earlier anywhere."""
    first = {}
    for d in sorted(texts):
        words = python_words(texts[d])
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (d, i))
    out = {}
    for d, text in texts.items():
        words = python_words(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def passages(seed, n=60):
    rng = random.Random(seed)
    few = [f"v{i}" for i in range(12)]
    word = lambda: rng.choice(few) if rng.random() < 0.5 else f"u{rng.randrange(3000)}"
    shared = [[word() for _ in range(rng.choice([5, 12, 19, 20, 21, 30, 60]))] for _ in range(12)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(40))]
        out.append(" ".join(text))
        if rng.random() < 0.2:
            out.append(out[rng.randrange(len(out))])
    return out


@pytest.mark.parametrize("window", [20, 5, 2, 23])
def test_against_brute_force(spark, window):
    texts = ODD_TEXTS + passages(window) + ["a b " * 60, "a " * 45]
    docs = odd_documents(spark, texts)
    assert rows(substring_dedup(docs, window)) == brute({i * 3: t for i, t in enumerate(texts)}, window)


def test_empty_nulls_and_equal_ids(spark):
    assert substring_dedup(odd_documents(spark).limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(df).collect()), key=str)
    assert got == [(4, 30, 0), (4, 30, 0), (5, 0, 0), (9, 30, 30), (None, 30, 30)]


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    from heronq.llm.substring_dedup import without_repeats

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    text, passage = words("w", 30), words("p", 25)
    for shared in (None, 7):
        copy, clean, short, late = text, words("x", 60), "a few words", f"{words('y', 10)} {passage} {words('z', 10)}"
        df = spark.createDataFrame([(3, text), (4, passage), *((shared, t) for t in (copy, clean, short, late, late))], "doc_id long, text string")
        got = sorted((r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df).collect() if r.doc_id == shared)
        cut = (45, 25, f"{words('y', 10)} {words('z', 10)}")
        assert got == sorted([(30, 30, ""), (60, 0, clean), (3, 0, short), cut, cut])
        assert sorted(r.text for r in without_repeats(df).collect() if r.doc_id == shared) == sorted(x[2] for x in got)
    a, b = f"{words('a', 5)} {passage}", f"{passage} {words('b', 9)} {passage}"
    got = substring_dedup(spark.createDataFrame([(7, a), (7, b)], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(30, 0), (59, 25)]  # neither row is earlier; b repeats itself


def test_nothing_repeats(spark):
    df = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(50))) for i in range(5)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring_dedup(df).collect())


def test_op4_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in brute(texts, 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, sf_dir).collect()} == want


def test_every_window_holds_a_half_around_its_anchor():
    rng = np.random.default_rng(0)
    for window in (2, 3, 4, 5, 7, 20, 21):
        first = np.array([0, 300, 300, 300 + window - 1, 400])
        row = Windows(rng.integers(1, 10, 400, dtype=np.uint64) * np.uint64(2**40), first, window)
        repeated = np.concatenate([(h & held.SENT) | np.uint64(k << held.SENT_BITS) for k, h in enumerate(row.anchor_hashes())])
        (p, right, left), (start, _, at, to_right) = row.around(repeated)
        assert start.tolist() == [i for a, z in zip(first, first[1:]) for i in range(a, z - window + 1)]
        assert p.tolist() == sorted(set(at.tolist())) == row.place.tolist()
        assert ((start <= at) & (at + row.base <= start + window)).all()
        assert (to_right | (at - row.base >= start)).all()  # the half to the left lies in the window
        assert (right[np.searchsorted(p, at[to_right])] != 0).all() and (left[np.searchsorted(p, at[~to_right])] != 0).all()
    assert anchors(np.array([3, 1, 1, 2], np.uint64) << np.uint64(40), 3).tolist() == [1, 1]
    h = rng.integers(0, 2**60, 10, dtype=np.uint64)
    assert len(double(h, 4)) == 6 and len(double(h, 10)) == 0
