import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece

from heronq.llm import queries
from heronq.llm.quality_rules import MIN_WORDS, Band, quality_rules, script_of
from tests.llm.cases import ODD_TEXTS, odd_documents, python_words

MODEL = P.path("piece_bpe_32k.model")


def brute(text):
    words = python_words(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(python_words(line))
        seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < MIN_WORDS or 100 * len(covered) > 50 * n)


def check(rows, texts, bands):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        ids = [i for w in python_words(text) for i in sp.encode(w)]
        if not ids:
            assert not r.kept and r.chars_per_token == 0
            continue
        share = np.array(list(Counter(ids).values())) / len(ids)
        entropy = -(share * np.log2(share)).sum() + (len(share) - 1) / (2 * len(ids) * np.log(2))
        assert abs(r.entropy_bits - entropy) < 1e-9 and abs(r.chars_per_token - want[1] / len(ids)) < 1e-12
        assert abs(r.byte_share - np.mean([sp.is_byte(i) for i in ids])) < 1e-12
        if r.base_failed:
            assert not r.kept
        elif bands and r.lang in bands:
            band = bands[r.lang]
            assert abs(r.tokens_per_word - len(ids) / want[0]) < 1e-12
            assert r.kept == band.holds(r.chars_per_token, r.byte_share, r.entropy_bits, r.tokens_per_word)


def test_odd_rows_against_brute_force(spark):
    docs = odd_documents(spark)
    bands = {"en": Band((0.0, 99.0), 1.0, (0.0, 99.0), 99.0)}
    got = quality_rules(docs, MODEL, bands).join(docs.select("doc_id", "lang"), "doc_id")
    check(got.collect(), {i * 3: t for i, t in enumerate(ODD_TEXTS)}, bands)
    assert quality_rules(docs.limit(0), MODEL).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op3_quality_rules(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    check(got, {r.doc_id: r.text for r in docs.collect()}, queries.FERTILITY_BANDS)


def test_good_documents_stay_and_repetition_goes(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality_rules(spark, d).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [r.kept for r in rows if labels[r.doc_id] == 1], [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and len(bad) > 10 and sum(bad) <= 0.2 * len(bad)


def test_scripts():
    assert [script_of(t) for t in ("hello", "привет", "日本語テキスト", "γειά", "123", "שלום")] == ["latin", "cyrillic", "han", "greek", "latin", "other"]


def test_script_is_judged_on_the_whole_text():
    assert script_of("б" + "a" * 3 + "бб" * 600) == "cyrillic"
    assert script_of(("a" + "б" * 9) * 256) == "cyrillic"  # every tenth letter would say latin
    assert script_of("日本語 テキスト x") == "han" and script_of("12 !") == script_of("") == "latin"
