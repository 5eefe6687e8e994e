"""Mixes: shares, repeats and nested selections."""

import pytest
from pyspark.sql import functions as F

from corpusflow.llm.mixing import mix_sources, share_report, sized_records

TARGETS = "mix_id string, source_key string, target_share double, max_repeats int, tokens int"


def records(spark, n=4000):
    rows = [(i, ["Big_One", " small", "tiny", "big one"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], "x" * (1 + i * 7919 % 50), i) for i in range(n)] + [(9999, None, "x", 0), (9998, "small", None, 0), (9997, "small", "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    return sized_records(frame, lambda t: F.length(t).cast("long"))


def test_shares_and_repeats(spark):
    base = records(spark)
    targets = spark.createDataFrame([("m", "big-one", 0.5, 1, 0), ("m", "small", 0.3, 2, 0), ("m", "tiny", 0.2, 4, 0), ("m", "tiny", 0.2, 4, 0), ("gap", "big-one", 0.5, 1, 0), ("gap", "missing", 0.5, 3, 0)], TARGETS)
    selected, plans = mix_sources(base, targets)
    shares = {(r["mix_id"], r["source_key"]): r for r in share_report(selected, plans).collect()}
    assert len(shares) == 5
    for key, wanted in {("m", "big-one"): 0.5, ("m", "small"): 0.3, ("m", "tiny"): 0.2, ("gap", "big-one"): 1.0, ("gap", "missing"): 0.0}.items():
        assert abs(shares[key]["share"] - wanted) < 0.0005
    most = {r["source_key"]: (r["lo"], r["hi"]) for r in selected.where("mix_id = 'm'").groupBy("source_key").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()}
    assert most["tiny"] == (4, 4) or most["tiny"][1] <= 4
    assert most["big-one"][1] == 1 and most["small"][1] <= 2
    assert selected.count() == selected.select("mix_id", "source_key", "doc_id").distinct().count()


@pytest.mark.parametrize("budget", [100, 5_000, 40_000])
def test_budget_is_met_and_selections_nest(spark, budget):
    base = records(spark)
    targets = spark.createDataFrame([("a", "big-one", 1.0, 1, 0)], TARGETS)
    picked = {r["doc_id"] for r in mix_sources(base, targets, budget)[0].collect()}
    more = {r["doc_id"] for r in mix_sources(base, targets, 2 * budget)[0].collect()}
    tokens = sum(r["tokens"] for r in base.where("source_key = 'big-one'").collect() if r["doc_id"] in picked)
    assert abs(tokens - budget) <= 2 and len(picked - more) <= 1


def test_a_capped_source_falls_short_and_says_so(spark):
    base = records(spark)
    targets = spark.createDataFrame([("m", "big-one", 0.4, 1, 0), ("m", "small", 0.2, 1, 0), ("m", "tiny", 0.4, 2, 0)], TARGETS)
    rows = {r["source_key"]: r for r in share_report(*mix_sources(base, targets)).collect()}
    sizes = {r["source_key"]: r["sum(tokens)"] for r in base.groupBy("source_key").sum("tokens").collect()}
    whole = sum(sizes.values())
    assert rows["tiny"]["tokens"] == 2 * sizes["tiny"] and abs(rows["tiny"]["short"] - (0.4 * whole - 2 * sizes["tiny"])) < 1
    assert all(abs(rows[s]["tokens"] - share * whole) <= 2 and rows[s]["short"] == 0 for s, share in (("big-one", 0.4), ("small", 0.2)))
    exact = {r["source_key"]: r for r in share_report(*mix_sources(base, targets, exact_shares=True)).collect()}
    assert all(abs(exact[s]["share"] - share) < 0.001 and exact[s]["short"] == 0 for s, share in (("big-one", 0.4), ("small", 0.2), ("tiny", 0.4)))


def test_few_long_records_come_near_the_budget(spark):
    sizes = [9000, *[10 * (1 + i % 30) for i in range(60)]]
    base = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "source_key string, doc_id long, tokens long").withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    for budget in (1000, 8000, 10_000, 12_345, 17_990):
        selected, _ = mix_sources(base, spark.createDataFrame([("m", "s", 1.0, 1, 0)], TARGETS), budget)
        assert abs(selected.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] - budget) <= 300


def test_empty(spark):
    base = records(spark)
    targets = spark.createDataFrame([], TARGETS)
    selected, plans = mix_sources(base, targets)
    assert selected.count() == 0 and share_report(selected, plans).count() == 0
    selected, plans = mix_sources(base.where("false"), spark.createDataFrame([("a", "x", 1.0, 1, 0)], TARGETS))
    assert selected.count() == 0 and [r["tokens"] for r in share_report(selected, plans).collect()] == [0]
