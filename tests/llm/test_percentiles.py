"""Percentiles by bisection and by ladders against sorting."""

import datetime as dt
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm.percentiles import ladder, percentiles_by_bisection, percentiles_of_ladders, usable_durations

T = dt.datetime(2025, 1, 1, 12)


def exact(values, pct):
    return sorted(values)[max(1, math.ceil(pct * len(values) / 100)) - 1]


def test_bisection_is_exact(spark):
    rng = random.Random(1)
    groups = {"hot": [rng.lognormvariate(6, 2) for _ in range(3000)], "ties": [5.0] * 70 + [7.0] * 30, "one": [3.0], "wide": [1e-12, 1.0, 1e300, -1e300], None: [float(i) for i in range(50)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("hot", float("inf"))]
    found = percentiles_by_bisection(spark.createDataFrame(rows, "g string, value double"), ["g"], [1, 50, 95, 99, 100]).collect()
    assert len(found) == 25
    for r in found:
        assert r["value"] == exact(groups[r["g"]], r["pct"]) and r["n_rows"] == len(groups[r["g"]])


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_bisection_on_any_numbers(spark, values):
    found = percentiles_by_bisection(spark.createDataFrame([(1, float(v)) for v in values], "g int, value double"), ["g"], [50, 99]).collect()
    assert {r["pct"]: r["value"] for r in found} == {p: exact(values, p) for p in (50, 99)}


def test_least_rows_and_empty(spark):
    frame = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, value double")
    assert [r["pct"] for r in percentiles_by_bisection(frame, ["g"], [50, 99], {99: 11}).collect()] == [50]
    assert percentiles_by_bisection(frame.where("false"), ["g"], [50]).count() == 0
    assert ladder(frame.where("false"), ["g"]).count() == 0


def test_ladders_add_up_within_their_error(spark):
    rng = random.Random(2)
    days = [(d, rng.lognormvariate(7, 1.5)) for d in range(6) for _ in range(500)]
    steps = ladder(spark.createDataFrame([*days, (0, -1.0), (0, None)], "day int, value double"), ["day"], 0.005)
    for r in percentiles_of_ladders(steps.drop("day"), [], [50, 90, 99], 0.005).collect():
        truth = exact([v for _, v in days], r["pct"])
        assert abs(r["value"] - truth) <= 0.0051 * truth and r["n_rows"] == len(days)


def test_usable_durations(spark):
    schema = "id string, provider string, created_at timestamp, duration_ms double, value double, log_day string"
    rows = [("1", " Stub ", T, 5.0, 0.0, "x"), ("1", "stub", T, 5.0, 0.0, "y"), ("2", None, T, 5.0, 0.0, ""), ("3", "a", T, float("nan"), 0.0, ""), ("4", "a", T, float("inf"), 0.0, ""), ("5", "a", T, 0.0, 0.0, ""), ("6", "a", T, None, 0.0, ""), (None, "a", T, 1.0, 0.0, ""), ("7", "a", None, 1.0, 0.0, "")]
    assert [tuple(r) for r in usable_durations(spark.createDataFrame(rows, schema)).collect()] == [("stub", "2025-01-01", 5.0)]
