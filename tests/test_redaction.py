"""Personal data, secrets and licences: planted cases, near misses, and checksums against plain arithmetic."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heronq.operators import redaction as R
from tests.odd import TEXTS

#: text, what is left of it
CASES = [
    ("mail ann.lee+x@mail.example.com now", "mail [EMAIL] now"),
    ("a..b@example.com .c@example.com d.@example.com e@-x.com f@localhost g@h.c1", "a..b@example.com .c@example.com d.@example.com e@-x.com f@localhost g@h.c1"),
    ("from 10.0.0.255, to 256.1.1.1 or 01.2.3.4", "from [ADDRESS], to 256.1.1.1 or 01.2.3.4"),
    ("pay 4111111111111111 or 4111-1111 1111 1111.", "pay [CARD] or [CARD]."),
    ("not 4111111111111112, 0000000000000000 nor 411111111111", "not 4111111111111112, 0000000000000000 nor 411111111111"),
    ("to DE89370400440532013000 and GB82 WEST 1234 5698 7654 32", "to [IBAN] and [IBAN]"),
    ("not DE88370400440532013000 nor GB82 TEST 1234 5698 7654 32", "not DE88370400440532013000 nor GB82 TEST 1234 5698 7654 32"),
    ("key=9233A8ECF7C5B09FE5949719B6B82BC439E9329B;", "[SECRET];"),
    ("aaaaaaaaaaaaaaaaaaaaaaaa1234 keitstlichschenverpfaendung " + "1234567890" * 5, "aaaaaaaaaaaaaaaaaaaaaaaa1234 keitstlichschenverpfaendung " + "1234567890" * 5),
    ("x@y.org x@y.org\nx@y.org", "[EMAIL] [EMAIL]\n[EMAIL]"),
    # a span goes to the first detector that accepts it, and a rejected one to the next
    ("ab3d5f7h9kAbCdEf.q@example.com", "[EMAIL]"),
    ("4927153860281734abcDEFghi", "[SECRET]"),
    ("", ""),
    ("é😀 1.2.3.4 é😀", "é😀 [ADDRESS] é😀"),
]


def test_planted_and_near_misses(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(CASES)], "doc_id long, text string, found string, marks int")
    got = {r.doc_id: r.redacted for r in R.personal_data(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_counts_and_licences(spark):
    texts = ["a@b.org 1.2.3.4 1.2.3.4", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "x\nThis is licensed under the GNU General Public License", "Copyright (c) 2020 me", "a licence", None]
    rows = R.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in rows}
    assert (by[0].n_email, by[0].n_address, by[0].n_card) == (1, 2, 0)
    assert [(by[i].n_licence, by[i].licence) for i in range(1, 6)] == [(2, "noncommercial"), (1, "copyleft"), (1, "other"), (0, None), (0, None)]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_checksums_and_entropy(spark):
    rng = random.Random(4)
    digits = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(13, 20))) for _ in range(400)]
    ibans = ["DE" + str(rng.randrange(10, 99)) + "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.randrange(11, 30))) for _ in range(3000)]
    words = ["".join(rng.choice("abcdef0123456789"[: rng.randrange(1, 16)]) for _ in range(30)) for _ in range(200)]
    got = spark.createDataFrame([(s,) for s in digits], "s string").select("s", R.luhn(F.col("s"))).collect()
    assert all(v == luhn(s) for s, v in got) and 20 < sum(v for _, v in got) < 80
    got = spark.createDataFrame([(s,) for s in ibans], "s string").select("s", R.good_iban(F.col("s"))).collect()
    assert all(v == iban(s) for s, v in got) and sum(v for _, v in got) > 10
    for s, v in spark.createDataFrame([(s,) for s in words], "s string").select("s", R.entropy(F.col("s"))).collect():
        assert v == pytest.approx(-sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()), abs=1e-12)


def test_odd_texts_stay(spark):
    texts = [*TEXTS, "a" * 200_000, "1" * 100_000, "A1" * 100_000, "@" * 50_000, "1x." * 50_000]
    docs = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = R.personal_data(docs)
    assert Counter(r.redacted for r in got.collect()) == Counter(t or "" for t in texts)
    assert R.personal_data(docs.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
