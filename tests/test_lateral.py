"""The two first orders of a customer, whatever order a shuffle delivers them in."""

import random

from heronq.plans.catalog import QUERIES


def test_order_is_part_of_the_rank(spark, tmp_path):
    rng = random.Random(1)
    orders = [(i if i % 7 else None, i % 40, float(rng.randrange(4)) if i % 11 else None) for i in range(800)]
    rng.shuffle(orders)
    spark.createDataFrame([(i,) for i in [*range(45), 3, None]], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(9).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["lateral_join"](spark, str(tmp_path))
    order = lambda o: (o[2] is None, -(o[2] or 0), o[0] is None, o[0] or 0)
    want = [(c, o[0]) for c in [*range(45), 3] for o in sorted((o for o in orders if o[1] == c), key=order)[:2]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "o_totalprice" in plan.split("windowspecdefinition")[1].split("specifiedwindowframe")[0]
