import random

import numpy as np
import pyarrow as pa
import pytest

from heronq.llm import common as C
from heronq.llm.components import connected_components
from tests.llm.cases import ODD_TEXTS, python_words


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_and_their_hashes(kind, monkeypatch):
    monkeypatch.setattr(C, "HASH_BYTES", 64)
    monkeypatch.setattr(C, "_powers", [])  # words longer than a block
    texts = ODD_TEXTS + ["x" * 500 + " y", "x" * 500, "y " + "x" * 500]
    column = pa.array(["sliced off", *texts], kind).slice(1)
    data, offsets = C.utf8(column)
    starts, ends, first = C.word_spans(data, offsets)
    words = [bytes(data[a:z]).decode() for a, z in zip(starts, ends)]
    assert [words[a:z] for a, z in zip(first, first[1:])] == [python_words(t) for t in texts]
    hashes = C.word_hashes(data, starts, ends)
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_words_hash_alike_in_any_block(monkeypatch):
    raw = np.frombuffer(b"ab" + b"long" * 90 + b" z", np.uint8)
    at = np.array([0, 363]), np.array([362, 364])
    got = []
    for size in (1 << 12, 64, 7):
        monkeypatch.setattr(C, "HASH_BYTES", size)
        monkeypatch.setattr(C, "_powers", [])
        got.append(C.word_hashes(raw, *at).tolist())
    assert got[0] == got[1] == got[2]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "two", "empty"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(300)] + [(i, i) for i in range(5)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] * 2,
        "two": [(7, 3), (9, 8), (3, 7)],
        "empty": [],
    }[shape]
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in root} and got.count() == len(root)
