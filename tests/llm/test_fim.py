import hashlib

import pytest
from pyspark.sql import functions as F

from heronq.llm import fim
from tests.llm.cases import ODD_TEXTS, odd_documents

TEXTS = [*ODD_TEXTS, "\x01", "\x02", "\x01\x02\x01d\x02e\x02d", "d\x02\x02e" * 9, "a<P>b", "<S>", "x<M>", "<<P<S><", "<P<S<M", ">P>S>M", "<P <S <M " * 20, "😀" * 50, "é\n\r \x00x" * 7, "$0 \\1 $", "x" * 2_000_000]


def plainly(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("shift", [0, 1])
def test_equals_slices_of_python_strings(spark, shift):
    rows = [(3 * i + 1000 * shift if i % 11 else None, t) for i, t in enumerate(TEXTS)]
    rows += [(7, "again"), (7, "again"), (7, "else")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, form string, n int, mark int")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plainly(*r) for r in rows), key=key)
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((i or 0, t or "") for i, t in rows)


def test_all_forms_and_cuts_occur(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a<b").alias("text"))
    got = fim.fill_in_middle(docs)
    share = {r.form: r["count"] for r in got.groupBy("form").count().collect()}
    assert 150 < share["plain"] < 250 and 280 < share["spm"] < 440 and set(share) == {"plain", "psm", "spm"}
    cuts = {(r.prefix_chars, r.middle_chars) for r in got.where("form <> 'plain'").select("prefix_chars", "middle_chars").distinct().collect()}
    assert cuts == {(a, b) for a in range(4) for b in range(4 - a)}


def test_other_units_and_empty_table(spark):
    docs = odd_documents(spark, ["ab \x01cd\x02  e", "one two  three\n"])
    got = fim.fill_in_middle(docs, rate=100, unit=r"[^\x02\s]+\s*|\s")
    for r in got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert r.back in ("ab \x01cd\x02  e", "one two  three\n") and r.n in (3, 7)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_no_shuffle_no_python(spark, sf_dir):
    from heronq.llm import queries

    plan = queries.op12_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("regexp_replace(") == 1
