import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heronq.llm import queries
from heronq.llm import spelling as S
from tests.llm.cases import odd_documents


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in counts if distance_one(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "w", "f") for r in rows], "doc_id long, text string, n int, word string, form string")


@pytest.mark.parametrize("letters", ["ab", "abcdefghéÿ", "xyz\U0001f600日"])
def test_neighbours(letters):
    rng = np.random.default_rng(len(letters))
    words = sorted({"".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 9))) for _ in range(400)})
    asked = words[::2] + ["", letters[0], letters[0] * 40, letters[0] * 41]
    trie = S.Trie.unpack(S.Trie(words, np.arange(len(words))).pack())
    w, v = trie.neighbours(*S.code_points(asked))
    assert sorted(zip(w.tolist(), v.tolist())) == sorted((i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if distance_one(a, b))
    long = ["ab" * 3000, "ab" * 3000 + "a", "ab" * 1500 + "b" + "ab" * 1500, "b" + "ab" * 2999 + "a"]
    w, v = S.Trie(sorted(long), np.ones(4, np.int64)).neighbours(*S.code_points(sorted(long)))
    assert len(w) == sum(distance_one(a, b) for a in long for b in long) > 0


def texts():
    rng = np.random.default_rng(5)
    words = ["receive", "recieve", "receives", "receiÿve", "Àpropos", "àpropos", "pro×pos", "pro÷pos", "naïvely", "naively", "aaaaa", "aaaaaa", "aaaaab", "aaaa", "bbbbbb", "straße", "strase", "STRASE", "Straše", "l'apropos"]
    weights = np.array([40, 9, 8, 4, 6, 3, 3, 3, 12, 5, 20, 10, 5, 9, 9, 6, 6, 6, 9, 3.0])
    return [(int(i) if i % 9 else None, " ".join(words[k] for k in rng.choice(len(words), 60, p=weights / weights.sum()))) for i in range(60)]


def test_against_brute_force(spark):
    rows = texts()
    rows += [(7, "chain" + "s" * k + " ") for k in range(6) for _ in range(3 * 2 ** (5 - k))]  # forms that lead on
    rows += [(i, t) for i, t in enumerate([None, "", " ", "日本語 abcde’fghij ÂÃÿþý", "abcdefghij" * 500, "abcdefghij" * 500, "abcdefghij" * 500])]
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)
    assert got(S.spelling_variants(table(spark, rows))) == want
    # many shards, several broadcasts, words longer than a shard
    assert got(S.spelling_variants(table(spark, rows), shard_chars=40, broadcast_bytes=60_000)) == want


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    assert got(S.spelling_variants(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert S.spelling_variants(odd.limit(0)).count() == 0


def test_op13_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert got(queries.op13_spelling_variants(spark, sf_dir)) == brute(rows)
