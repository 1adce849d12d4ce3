"""Near duplicates by min-wise hashing against all pairs of sets, and components against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heronq.operators import minhash
from heronq.operators.graph import components, reachable
from heronq.operators.minhash import near_duplicates, shingle_sets, signatures
from tests.odd import TEXTS


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_texts(groups, size, seed):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
            out.append(" ".join(t))
    return out


def links(sets, percent):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links(sets, percent):
        root[max(find(i), find(j))] = min(find(i), find(j))
    name = lambda group, own: min((rows[k][0] for k in group if rows[k][0] is not None), default=own)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        same = [k for k in range(len(rows)) if sets[k] == sets[i]] if sets[i] else [i]
        out.append((doc_id, len(sets[i]), name(same, doc_id), name([k for k in range(len(rows)) if find(k) == find(i)], doc_id)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rounds", [0, 3])
def test_against_all_pairs(spark, rounds, monkeypatch):
    monkeypatch.setattr("heronq.operators.minhash.FEW_PAIRS", 0)
    rows = [(5 * i if i % 6 else None, t) for i, t in enumerate(TEXTS)]
    rows += [(1000 - i if i % 10 else None, t) for i, t in enumerate(near_texts(4, 25, 7))]
    rows += [(7, "same words in two rows of one id"), (7, "same words in two rows of one id"), (7, "other words"), (9, "Same  WORDS in two rows of one id")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, members string, row int, n int")
    got = near_duplicates(docs, rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 5, 80)
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 4])
def test_what_banding_misses_is_found(spark, few, monkeypatch):
    """One band of many rows meets hardly any pair; the answer is exact all the same, for sets just at the threshold too."""
    monkeypatch.setattr("heronq.operators.minhash.FEW_PAIRS", few)
    rng = random.Random(5)
    texts = near_texts(5, 12, 11) + [" ".join(f"s{rng.randrange(9)}" for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    for g in range(6):  # 40 of 50 shingles in common, and 39 of 51
        w = [f"t{g}x{i}" for i in range(60)]
        texts += [" ".join(w[:44] + ["end"]), " ".join(w[:48]), " ".join(w[:45] + [f"a{i}" for i in range(5)]), " ".join(w[:45] + [f"b{i}" for i in range(5)]), " ".join(w[:44] + [f"c{i}" for i in range(4)])]
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=24)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 5, 80)


def test_sets_without_partners_are_no_rows(spark, monkeypatch):
    """Tokens are rows only of classes that share enough with another one: no table outgrows the documents, copies are no partners."""
    monkeypatch.setattr("heronq.functions.shingles.BATCH_ROWS", 7)
    made, settle = {}, minhash.settled
    monkeypatch.setattr(minhash, "settled", lambda df, name="table": made.setdefault(name, []).append(settle(df, name)) or made[name][-1])
    rng = random.Random(9)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) for _ in range(240)]
    texts += texts[:20] * 2 + [texts[0] + " one", "two " + texts[1], "  " + texts[2].upper() + " three"] + ["", None]
    rows = list(enumerate(texts))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 5, 80)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    counts = {name: max(t.count() for t in tables) for name, tables in made.items()}
    assert max(counts.values()) == len(rows) and counts["some"] == counts["sets"] == 6


def test_recall_of_the_bands(spark):
    """Of all pairs at or above the threshold, the share that meets in a band; pairs far below seldom meet."""
    rows = list(enumerate(near_texts(12, 20, 3)))
    sets = [shingles(t, 5) for _, t in rows]
    want = {(j, i) for i, j in links(sets, 80) if sets[i] != sets[j]}
    assert len(want) > 300
    signed = signatures(shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5), 16, 6)
    dealt = signed.select("doc_id", F.posexplode("keys").alias("band", "key"))
    other = dealt.withColumnRenamed("doc_id", "b")
    met = {(r.doc_id, r.b) for r in dealt.join(other, ["band", "key"]).where("doc_id < b").select("doc_id", "b").distinct().collect()}
    assert len(want & met) >= 0.98 * len(want)
    apart = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) < 0.2 * len(sets[i] | sets[j])]
    assert sum((j, i) in met for i, j in apart) <= 0.05 * len(apart)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range([40, 70, 200][seed])] + [(5, 5), (None, 3), (3, None)]
    edges += [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2001 + i) for i in range(60)] + [(-5, 2030), (-5, 2030)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_reachable_ends_on_cycles(spark):
    links = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 6), (None, 7), (4, None), (2, 3)] + [(100 + i, 101 + i) for i in range(20)]
    seeds = [(1,), (1,), (None,), (50,), (100,), (110,)]
    got = reachable(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(seeds, "node long"))
    want = {1: 0, 2: 1, 3: 2, 4: 3, 50: 0} | {100 + i: min(i, i - 10 if i >= 10 else i) for i in range(21)}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert reachable(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([], "node long")).count() == 0
