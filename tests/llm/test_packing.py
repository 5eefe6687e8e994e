"""Containers: limits, completeness and fill."""

from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm.packing import fill, fill_report, limit_report, pack

SCHEMA = "doc_id long, tokens long, loss_tokens long, container_name string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 100)), min_size=1, max_size=60))
def test_fill_keeps_all_limits(pairs):
    sizes = np.array([(t, 1, min(l, t, 60)) for t, l in pairs], float)
    number = fill(sizes, np.array([100.0, 5.0, 60.0]))
    assert (number >= 0).all()
    for n in range(number.max() + 1):
        assert (sizes[number == n].sum(0) <= [100, 5, 60]).all() and (number == n).any()


def test_pack(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in np.minimum(rng.lognormal(4.5, 1.2, 3000), 9000)]
    rows = [(i, n, n // 2, "clash") for i, n in enumerate(sizes)] + [(5001, 0, 0, ""), (5002, None, None, ""), (5003, 512, 512, ""), (5004, 1536, 0, "")]
    items = spark.createDataFrame(rows, SCHEMA)
    out = pack(items, [("small", 512), ("big", 4096)], lambda capacity: max(8, capacity // 16), batch=500)
    used, pieces = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for r in out.collect():
        pieces[r["container_name"], r["doc_id"]].append(r)
        if r["container_id"]:
            u = used[r["container_name"], r["container_id"]]
            u[0] += r["tokens"]
            u[1] += 1
            u[2] += r["loss_tokens"]
    for (name, _), (tokens, n, _) in used.items():
        capacity = {"small": 512, "big": 4096}[name]
        assert tokens <= capacity and n <= max(8, capacity // 16)
    for name, capacity in (("small", 512), ("big", 4096)):
        for i, n, loss, _ in rows:
            got = pieces[name, i]
            assert sum(r["tokens"] for r in got) == (n or 0) and sum(r["loss_tokens"] for r in got) == (loss or 0)
            assert len(got) == max(1, -(-(n or 0) // capacity)) and (n or got[0]["container_id"] is None)
    report = {r["container_name"]: r for r in fill_report(out, spark.createDataFrame([("small", 512), ("big", 4096)], "container_name string, capacity_tokens long")).collect()}
    assert report["small"]["fill"] > 0.97 and report["big"]["fill"] > 0.97


def test_loss_limit(spark):
    items = spark.createDataFrame([(i, 40, 40, "") for i in range(20)], SCHEMA)
    out = pack(items, [("c", 100)], loss_share=0.5).groupBy("container_id").sum("loss_tokens").collect()
    assert all(r[1] <= 50 for r in out) and len(out) == 20


def test_each_limit_binds_somewhere(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(n), int(n * share), "") for i, (n, share) in enumerate(zip(rng.integers(1, 400, 2000), rng.uniform(0.5, 1.0, 2000)))] + [(3000 + i, 3, 3, "") for i in range(1500)]
    sizes = spark.createDataFrame([("c", 512)], "container_name string, capacity_tokens long")
    report = limit_report(pack(spark.createDataFrame(rows, SCHEMA), [("c", 512)], lambda capacity: 8, 0.8), sizes, lambda capacity: 8, 0.8).first()
    assert report["n_texts"] == 3500 and report["n_over"] == report["n_torn"] == 0
    assert min(report["by_tokens"], report["by_segments"], report["by_loss"]) > 0


def test_empty(spark):
    items = spark.createDataFrame([], SCHEMA)
    assert pack(items, [("c", 10)]).count() == 0 and pack(items, []).count() == 0
