import random

import numpy as np
import pytest

from heronq.llm import held, jaccard, queries
from tests.llm.cases import ODD_TEXTS, odd_documents, python_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = python_words((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, n, percent):
    """{doc_id: (set size, component)} by comparing every pair."""
    ids = sorted(texts)
    sets = {d: shingles(texts[d], n) for d in ids}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def copies(seed, groups=12):
    """Texts with chains of edits, a passage in nearly all of them, and a large group around one origin."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijk") + rng.choice("lmnop") + str(rng.randrange(40))
    passage = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 30, 120]))]
        if g % 2:
            base += passage
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
            if rng.random() < 0.3:
                base = w
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, percent, rounds", [(4, 85, None), (5, 80, 1), (4, 85, 0), (1, 60, None), (1, 60, 0)])
def test_against_brute_force(spark, monkeypatch, n, percent, rounds):
    if rounds is not None:
        monkeypatch.setattr(jaccard, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(held, "CHUNK_TOKENS", 2000)
    texts = ODD_TEXTS + copies(n)
    docs = odd_documents(spark, texts)
    assert rows(jaccard.join_components(docs, n, percent)) == brute({i * 3: t for i, t in enumerate(texts)}, n, percent)


def test_empty_null_ids_and_equal_ids(spark):
    docs = odd_documents(spark)
    assert jaccard.join_components(docs.limit(0)).count() == 0
    few = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.join_components(few).collect()), key=str) == [(5, 5), (5, 5), (None, 5), (None, None)]


def test_op1_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows(queries.op1_jaccard_join(spark, sf_dir)) == brute(texts, 4, 85)


def test_null_ids_take_part(spark):
    """A set that only rows without id have links two documents; alone it is named by no id."""
    base = [f"w{i}" for i in range(40)]
    edit = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    rows = [(1, edit()), (None, edit(0)), (2, edit(0, 39)), (None, "p q r s t u v"), (None, "p q r s t u v"), (9, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_components(docs, 2, 92).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (9, 9)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_similar_sets_share_prefix_tokens_under_every_order(percent):
    rng = np.random.default_rng(percent)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        only = rng.integers(0, 2**63, n, dtype=np.uint64)
        room = n * (100 - percent) // percent  # symmetric difference that similarity allows
        k = int(rng.integers(0, room + 1)) if room else 0
        a, b = np.unique(np.concatenate([both, only[:k]])), np.unique(np.concatenate([both, only[k:room]]))
        assert 100 * jaccard.overlap(a, b) >= percent * len(np.union1d(a, b))
        # how many sets hold each token: one where it is in only one of the two and in no third
        held = {t: int(rng.integers(2, 50)) for t in both.tolist()} | {t: int(rng.integers(1, 50)) for t in only.tolist()}
        found = []
        for s in (a, b):
            m = np.array([held[t] for t in s.tolist()])
            some = s[m > 1]
            found.append([some[o] for o in jaccard.shared_prefixes(len(s), some, m[m > 1], percent)])
        for x, y in zip(*found):
            assert np.intersect1d(x, y).size
