"""Percentiles per group of very large numeric columns, by exact bisection, and ladders of counts that add up.

``percentiles_by_bisection`` keeps one value interval per group and percentile. A pass counts the rows of each
interval below its midpoints - four levels of halving at once, so 15 midpoints - and narrows the interval to the
cell that holds the target rank, tightened to the least and greatest value in it. A rank is resolved once those are
equal. A pass moves nothing but counts, which are combined before the shuffle, so a group with a third of all rows
costs no more than others; as soon as the intervals hold a quarter of the rows or fewer, only those are read on.

``ladder`` counts the rows of each group on rungs whose ends differ by a fixed ratio. Ladders of days or partitions
are added up by summing, and give any percentile of the union within the ratio's relative error.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import checkpointed

#: Intervals are broadcast up to this many (about 100 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 100_000
CELLS = 16
#: Parts that each group is spread over where the intervals are too many to be broadcast.
PARTS = 16


def usable_durations(logs: DataFrame, value: str = "duration_ms") -> DataFrame:
    """(provider, log_day, value): one row for each ``id`` of ``query_logs``.

    Providers are trimmed and lower-cased; null ids and providers and values that are null, NaN, infinite or not
    above zero are left out. Rows of one id agree in all that is used here, so equal rows are one.
    """
    v = F.col(value).cast("double")
    good = F.col("id").isNotNull() & F.col("provider").isNotNull() & F.col("created_at").isNotNull() & (v > 0) & ~F.isnan(v) & (v < float("inf"))
    # Days are UTC's, whatever the session's zone.
    day = F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd").alias("log_day")
    return logs.where(good).select("id", F.lower(F.trim("provider")).alias("provider"), day, v.alias("value")).distinct().drop("id")


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))


def _within(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    met = _same(keys) & F.col("value").between(F.col("lo"), F.col("hi"))
    return rows.join(bounds, met & (F.col("_salt") == F.col("_part")) if "_part" in bounds.columns else met)


def percentiles_by_bisection(values: DataFrame, groups: list[str], pcts: list[int], least_rows: dict[int, int] | None = None) -> DataFrame:
    """(groups..., pct, n_rows, value): the value of rank ceil(pct / 100 * n) of each group, exactly.

    ``values`` has the group columns and ``value`` (double; nulls and NaN are left out, infinities too). Groups
    may be null, which is a group of its own. ``least_rows`` has for a percentile the least rows of a group that is reported. An empty
    input gives an empty result; ties are no case of their own, as equal values share their rank's value.
    """
    v = F.col("value")
    rows = checkpointed(values.select(*groups, v.cast("double").alias("value")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.lit((least_rows or {}).get(p, 1)).alias("least")) for p in pcts]))
    state = rows.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.min("value").alias("lo"), F.max("value").alias("hi")).select("*", wanted.alias("w")).select("*", "w.*").where("n_rows >= least")
    state = state.select(*groups, "pct", "n_rows", "lo", "hi", F.ceil(F.col("pct") * F.col("n_rows") / 100).alias("rank"), F.col("n_rows").alias("inside"))
    state, resolved, keys = checkpointed(state), [], list(groups)
    total = None
    while True:
        resolved.append(state.where("lo = hi").select(*groups, "pct", "n_rows", F.col("lo").alias("value")))
        state = state.where("lo < hi")
        n, inside = state.agg(F.count("*"), F.sum("inside")).first()
        if not n:
            break
        total = total or rows.count()
        bounds = state.select(*(F.col(k).alias(f"_{k}") for k in [*groups, "pct"]), "lo", "hi", "rank", "n_rows")
        if n <= BROADCAST_ROWS:
            near, salts = F.broadcast(bounds), [F.lit(0)]
        else:
            # A group may hold a third of all rows: it is spread over parts, and each part gets the group's intervals.
            near, salts = bounds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [F.pmod(F.xxhash64("value"), F.lit(PARTS)).cast("int")]
        rows = rows.withColumn("_salt", salts[0])
        met = _within(rows, near, keys).select(*groups, F.col("_pct").alias("pct"), "value", "lo", "hi")
        if inside * 4 <= total:
            rows = checkpointed(met.select(*groups, "pct", "value"))
            keys, total = [*groups, "pct"], inside
            met = _within(rows.withColumn("_salt", salts[0]), near, keys)
        cell = F.least(F.lit(CELLS - 1), F.floor(F.coalesce(F.try_divide(F.col("value") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0)) * CELLS))
        counts = met.groupBy(*groups, "pct", cell.alias("cell")).agg(F.count("*").alias("here"), F.min("value").alias("cell_lo"), F.max("value").alias("cell_hi"))
        counts = counts.withColumn("upto", F.sum("here").over(Window.partitionBy(*groups, "pct").orderBy("cell")))
        reached = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("here") < F.col("rank"))
        chosen = counts.join(bounds, _same([*groups, "pct"]) & reached)
        narrowed = chosen.select(*groups, "pct", "n_rows", F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"), (F.col("rank") - F.col("upto") + F.col("here")).alias("rank"), F.col("here").alias("inside"))
        state = checkpointed(narrowed)
    return reduce(DataFrame.unionByName, resolved)


def ladder(values: DataFrame, groups: list[str], error: float = 0.005) -> DataFrame:
    """(groups..., rung, n_rows): counts on rungs of relative width; sum ``n_rows`` by rung to add ladders up.

    ``value`` must be above zero; other values, nulls and NaN are left out. The middle of a rung is within ``error`` of
    every value on it.
    """
    ratio = (1 + error) / (1 - error)
    v = F.col("value")
    rung = F.ceil(F.log(v) / math.log(ratio)).cast("int")
    return values.where((v > 0) & (v < float("inf"))).groupBy(*groups, rung.alias("rung")).agg(F.count("*").alias("n_rows"))


def percentiles_of_ladders(ladders: DataFrame, groups: list[str], pcts: list[int], error: float = 0.005) -> DataFrame:
    """(groups..., pct, n_rows, value): percentiles of added ladders, within ``error`` of the exact value.

    A group has at most one row a rung - a few thousand - whatever the rows behind them.
    """
    ratio = (1 + error) / (1 - error)
    summed = ladders.groupBy(*groups, "rung").agg(F.sum("n_rows").alias("here"))
    whole = Window.partitionBy(*groups)
    summed = summed.withColumn("upto", F.sum("here").over(whole.orderBy("rung"))).withColumn("n_rows", F.sum("here").over(whole))
    each = summed.select("*", F.explode(F.array(*map(F.lit, pcts))).alias("pct")).withColumn("rank", F.ceil(F.col("pct") * F.col("n_rows") / 100))
    hit = each.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("here") < F.col("rank")))
    middle = 2 * F.pow(F.lit(ratio), F.col("rung")) / (ratio + 1)
    return hit.select(*groups, "pct", "n_rows", middle.alias("value"))
