import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from heronq.llm import bpe, codec, pfor, queries, token_files
from heronq.llm.wordcache import LibraryEncoder
from tests.llm.cases import ODD_TEXTS, odd_documents

FILE = P.path("byte_bpe_50k.json")


def random_texts(n=1500):
    rng = random.Random(7)
    return ["".join(rng.choice(" \n\tab1'!sé ́Ġ中  ") for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_equals_library(name):
    encoder = LibraryEncoder(P.path(name), entries=500)  # few entries, so that generations change
    texts = [t or "" for t in ODD_TEXTS] + random_texts()
    want = [np.asarray(e.ids, "<u4").tobytes() for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [encoder([t])[0] for t in texts[:200]] == want[:200]
        assert encoder(texts) == want


def test_segment_tree_equals_library():
    tree, library = bpe.SegmentTreeBPE(FILE, P.PATTERN, entries=500), Tokenizer.from_file(FILE)
    texts = [t or "" for t in ODD_TEXTS] + random_texts()
    got = tree.encode(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert tree.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_decode_replaces_bytes_that_are_not_text():
    tree, library = bpe.SegmentTreeBPE(FILE, P.PATTERN), Tokenizer.from_file(FILE)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randint(1, 9))]
        assert tree.decode(np.asarray(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_root_takes_leftmost_lowest_rank():
    tree = bpe.SegmentTreeBPE(FILE, P.PATTERN)
    library = Tokenizer.from_file(FILE)
    pieces = ["a" * n for n in (1, 2, 3, 7, 64, 65, 5000)]
    for piece, ids in zip(pieces, tree.merge([p.encode() for p in pieces])):
        assert ids.tolist() == library.encode(piece, add_special_tokens=False).ids


def test_long_unbroken_words():
    """Alone or among others, of letters in any order; a word of 200,000 letters takes seconds, not minutes."""
    tree, library = bpe.SegmentTreeBPE(FILE, P.PATTERN), Tokenizer.from_file(FILE)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1, 2, 3, 9, 17, 900, 1000, 20_000, 200_000)]
    for some in (words, [w for w in words[:6] for _ in range(9)]):
        for word, ids in zip(some, tree.merge([w.encode() for w in some])):
            assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
    for word in words:
        assert tree._merge_one(word.encode()).tolist() == tree._merge_group([word.encode()] * 2, 1 << max(1, (len(word) - 1).bit_length()))[0].tolist() if len(word) < 2000 else True


def test_codec_query_on_odd_rows(spark):
    docs = odd_documents(spark)
    library = Tokenizer.from_file(FILE)
    got = {r.doc_id: r for r in codec.round_trip(docs, FILE, P.PATTERN).collect()}
    assert len(got) == len(ODD_TEXTS)
    for i, text in enumerate(ODD_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i * 3].ids, "<u4").tolist() == ids
        assert got[i * 3].decoded == library.decode(ids, skip_special_tokens=False)
    two_steps = codec.decode(codec.encode(docs, FILE, P.PATTERN), FILE, P.PATTERN)
    assert {r.doc_id: r.text for r in two_steps.collect()} == {k: r.decoded for k, r in got.items()}
    assert codec.round_trip(docs.limit(0), FILE, P.PATTERN).count() == 0


def test_op9_query(spark, sf_dir):
    library = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_bpe_codec(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.9, 1.0])
def test_pfor_round_trip(percentile):
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 2**32, 5, dtype=np.uint32), np.zeros(0, np.uint32), rng.integers(0, 50_000, 3000, dtype=np.uint32), np.full(128, 2**32 - 1, np.uint32), np.where(rng.random(700) < 0.05, 2**31, rng.integers(0, 30, 700)).astype(np.uint32), np.zeros(1, np.uint32)]
    f = io.BytesIO()
    writer = pfor.Writer(f, percentile)
    for i, d in enumerate(documents):
        writer.add(i - 2, d)
    writer.close()
    reader, all_ids = pfor.Reader(f), np.concatenate(documents)
    assert reader.values(0, reader.total).tolist() == all_ids.tolist()
    for a, b in [(0, 1), (127, 129), (5, 5), (3000, 3500), (len(all_ids) - 1, len(all_ids))]:
        assert reader.values(a, b).tolist() == all_ids[a:b].tolist()
    at = np.cumsum([0, *map(len, documents)])
    for chunk in (100, 10**6):
        assert list(reader.documents(chunk)) == [(i - 2, at[i], len(d), zlib.crc32(d.tobytes())) for i, d in enumerate(documents)]


def test_pfor_keeps_outliers_as_exceptions():
    values = np.full(128, 3, np.uint32)
    values[7] = 10**9
    assert len(pfor.encode_blocks(values, 0.9)[0]) == 7 + 0 + 1 + 4
    assert len(pfor.encode_blocks(values, 1.0)[0]) > 7 + 128 * 29 // 8
    assert pfor.encode_blocks(np.zeros(0, np.uint32)) == []


def expected_starts(texts_by_id):
    library, at, out = Tokenizer.from_file(FILE), 0, {}
    for doc_id, text in sorted(texts_by_id.items()):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out[doc_id] = (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_token_files_on_odd_rows(spark):
    docs = odd_documents(spark)
    want = expected_starts({i * 3: t for i, t in enumerate(ODD_TEXTS)})
    for shard_rows in (4, 1000):
        manifest = token_files.encode_to_files(docs, FILE, shard_rows=shard_rows)
        assert manifest.count() > 1 or shard_rows == 1000
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_files(manifest).collect()} == want
    assert token_files.read_files(token_files.encode_to_files(docs.limit(0), FILE)).count() == 0


def test_op2_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, sf_dir).collect()}
    assert got == expected_starts(texts)


def test_token_files_with_null_and_equal_ids(spark):
    """Null ids come first, rows of one id stand together, and all starts are gapless however the rows are dealt to shards."""
    library = Tokenizer.from_file(FILE)
    rows = [(None, f"no id {i} " * (i % 5)) for i in range(30)] + [(7, f"seven {i} " * (i % 4)) for i in range(30)] + [(i, f"text {i}") for i in range(20, 30)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    for shard_rows in (3, 1000):
        got = token_files.read_files(token_files.encode_to_files(docs, FILE, shard_rows=shard_rows)).orderBy("start").collect()
        assert [r.doc_id for r in got] == [None] * 30 + [7] * 30 + [*range(20, 30)]
        want = sorted((str(d), zlib.crc32(np.asarray(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, t in rows)
        assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
