"""Mixing sources to target weights, by hash-threshold histograms.

Every record has a place in a fixed order, the hash of its id. Tokens are summed by source and hash bucket; a source's
budget is met by taking it whole as often as it goes and, once more, all records below a threshold. The threshold lies
in the bucket where the running sum reaches the rest of the budget; only that bucket is summed again, by finer buckets,
until a single record is left. What is missing then, less than that record, is filled by smaller ones that come next in
the order, or the record is taken and smaller ones before it are dropped. All mixes use one order, so a larger budget's selection holds a smaller one's but for those.
Records are then filtered by their hash; nothing is sorted, and only sums per bucket and the fillers are moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.keys import source_key
from corpusflow.session import broadcast_if_small, checkpointed

BITS = 9
LEVELS = 7


def sized_records(documents: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """(source_key, doc_id, tokens, place) of records with a source and tokens; ``place`` has 63 bits of the id's hash."""
    sized = documents.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select(source_key(F.col("source")).alias("source_key"), "doc_id", F.coalesce(tokens(F.col("text")), F.lit(0)).alias("tokens"))
    return sized.where("tokens > 0").withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))


def plan_budgets(targets: DataFrame, sizes: DataFrame, budget_tokens: int | None = None, exact_shares: bool = False) -> DataFrame:
    """(mix_id, source_key, target_share, max_repeats, size, goal, want) for each wanted source.

    ``goal`` is the source's part of the mix's size, and ``want`` what its repeats allow of that; where it is less, the
    source falls short and the others keep their parts. The mix's size is ``budget_tokens``, else what its sources hold
    when each record is used once. With ``exact_shares`` it is the largest at which no source falls short, so the sources
    hold exactly their shares, which a single small source can make very small. Shares are those among sources that have
    records; one without records has no goal. Equal rows of targets count once.
    """
    mix = Window.partitionBy("mix_id")
    wanted = targets.select("mix_id", source_key(F.col("source_key")).alias("source_key"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    wanted = wanted.groupBy("mix_id", "source_key").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(sizes, "source_key", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    there = (F.col("size") > 0) & (F.col("target_share") > 0)
    joined = joined.withColumn("_share", F.when(there, F.try_divide("target_share", F.sum(F.when(there, F.col("target_share"))).over(mix)))).withColumn("_most", (F.col("size") * F.col("max_repeats")).cast("double"))
    if exact_shares:
        budget = F.min(F.when(there, F.try_divide("_most", "_share"))).over(mix)
    elif budget_tokens is None:
        budget = F.sum(F.when(there, F.col("size"))).over(mix).cast("double")
    else:
        budget = F.lit(float(budget_tokens))
    goal = F.when(there, F.col("_share") * budget).otherwise(F.lit(0.0))
    return joined.withColumn("goal", goal).withColumn("want", F.least("_most", "goal")).drop("_share", "_most")


def thresholds(records: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix_id, source_key, whole, below, short): each record is used ``whole`` times, and once more if its place is under ``below``.

    ``short`` is what is then missing from the budget.
    """
    whole = F.least(F.col("max_repeats").cast("double"), F.floor(F.try_divide("want", "size"))).cast("int")
    open_ = plans.where("size > 0 and want > 0").withColumn("whole", whole)
    open_ = open_.withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.col("want") - F.col("whole") * F.col("size")).otherwise(F.lit(0.0)))
    state = checkpointed(open_.select("mix_id", "source_key", "whole", "rest", F.lit(0).cast("long").alias("cell"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("below")))
    for level in range(LEVELS):
        cut = 63 - BITS * (level + 1)
        active = broadcast_if_small(state.where("not done").select("mix_id", F.col("source_key").alias("_source"), "cell", "rest", "whole"))
        near = (F.col("source_key") == F.col("_source")) & (F.shiftright("place", cut + BITS) == F.col("cell"))
        # At the first level all mixes share one histogram of each source; below it only boundary cells are read.
        finer = F.shiftright("place", cut).alias("finer")
        if level == 0:
            sums = records.groupBy("source_key", finer).agg(F.sum("tokens").alias("here"), F.count("*").alias("n"))
            sums = sums.join(active.drop("cell"), F.col("source_key") == F.col("_source"))
        else:
            sums = records.join(active, near).groupBy("mix_id", "source_key", "rest", "whole", finer).agg(F.sum("tokens").alias("here"), F.count("*").alias("n"))
        upto = Window.partitionBy("mix_id", "source_key").orderBy("finer")
        sums = sums.withColumn("upto", F.sum("here").over(upto)).withColumn("before", F.col("upto") - F.col("here"))
        hit = sums.where((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        last = (F.col("n") == 1) | F.lit(level == LEVELS - 1)
        moved = hit.select("mix_id", "source_key", "whole", (F.col("rest") - F.col("before")).alias("rest"), F.col("finer").alias("cell"), last.alias("done"), F.shiftleft("finer", cut).alias("below"))
        state = checkpointed(state.where("done").unionByName(moved))
        if not state.where("not done").limit(1).count():
            break
    reached = state.select("mix_id", "source_key", "below", F.col("rest").alias("short"))
    joined = open_.select("mix_id", "source_key", "whole").join(reached, ["mix_id", "source_key"], "left")
    return joined.withColumns({"below": F.coalesce("below", F.lit(0).cast("long")), "short": F.coalesce("short", F.lit(0.0))})


def fillers(records: DataFrame, limits: DataFrame, next_records: int = 64) -> DataFrame:
    """(mix_id, source_key, fillers, dropped): places of records that are used once more, or once less, to come nearer to the budget.

    Of the ``next_records`` above the threshold each is taken, in their order, that still fits. If something is missing
    then, two more ways are tried: the smallest of those left over is taken too; and the first of them is, while of the
    ``next_records`` below the threshold, and of those just taken, each is dropped, from the last on, that what is too much
    then allows. What comes nearest to the budget stands, of equal ways the first. The lists of a source are small arrays.
    """
    place = ["mix_id", "source_key"]
    open_ = limits.where("short > 0").select(*place, "below", "short")
    near = records.join(open_, "source_key").withColumn("above", F.col("place") >= F.col("below"))
    order = F.when(F.col("above"), F.col("place")).otherwise(-F.col("place"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy(*place, "above").orderBy(order))).where(F.col("_n") <= next_records)
    row = F.struct("_n", "place", "tokens")
    listed = near.groupBy(*place).agg(F.max("short").alias("short"), *[F.array_sort(F.collect_list(F.when(side, row))).alias(n) for n, side in (("next", F.col("above")), ("last", ~F.col("above")))])

    def greedy(rows: Column, short: Column) -> Column:
        take = lambda s, r: F.when(r["tokens"] <= s["short"], F.struct((s["short"] - r["tokens"]).alias("short"), F.concat(s["taken"], F.array(r["place"])).alias("taken"))).otherwise(s)
        return F.aggregate(rows, F.struct(short.alias("short"), F.array().cast("array<bigint>").alias("taken")), take)

    filled = listed.withColumn("under", greedy(F.col("next"), F.col("short")))
    filled = filled.withColumn("rest", F.filter("next", lambda r: ~F.array_contains(F.col("under.taken"), r["place"])))
    filled = filled.withColumn("least", F.array_min(F.transform("rest", lambda r: F.struct(r["tokens"].alias("tokens"), r["place"].alias("place"))))).withColumn("first", F.try_element_at("rest", F.lit(1)))
    taken = F.filter("next", lambda r: F.array_contains(F.col("under.taken"), r["place"]))
    filled = filled.withColumn("over", greedy(F.concat(F.reverse(taken), "last"), F.col("first.tokens") - F.col("under.short")))
    none = F.array().cast("array<bigint>")
    way = lambda n, off, up, down: F.struct(off.alias("off"), F.lit(n).alias("n"), up.alias("fillers"), down.alias("dropped"))
    ways = F.array(
        way(0, F.col("under.short"), F.col("under.taken"), none),
        F.when(F.col("least").isNotNull(), way(1, F.col("least.tokens") - F.col("under.short"), F.concat("under.taken", F.array("least.place")), none)),
        F.when(F.col("first").isNotNull(), way(2, F.col("over.short"), F.concat("under.taken", F.array("first.place")), F.col("over.taken"))),
    )
    return filled.select(*place, F.array_min(F.array_compact(ways)).alias("w")).select(*place, "w.fillers", "w.dropped")


def mix_sources(records: DataFrame, targets: DataFrame, budget_tokens: int | None = None, exact_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_id, source_key, doc_id, copies, tokens) and the plan of ``plan_budgets``.

    ``records`` are rows of ``sized_records``. ``tokens`` are those of one copy. Empty tables give empty results.
    """
    records = checkpointed(records)
    sizes = records.groupBy("source_key").agg(F.sum("tokens").alias("size"))
    plans = checkpointed(plan_budgets(targets, sizes, budget_tokens, exact_shares))
    limits = broadcast_if_small(thresholds(records, plans))
    limits = broadcast_if_small(limits.join(fillers(records, limits), ["mix_id", "source_key"], "left"))
    once_more = (F.col("place") < F.col("below")) | F.coalesce(F.array_contains("fillers", F.col("place")), F.lit(False))
    once_less = F.coalesce(F.array_contains("dropped", F.col("place")), F.lit(False))
    copies = F.col("whole") + once_more.cast("int") - once_less.cast("int")
    selected = records.join(limits, "source_key").withColumn("copies", copies).where("copies > 0")
    return selected.select("mix_id", "source_key", "doc_id", "copies", "tokens"), plans


def share_report(selected: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix_id, source_key, target_share, max_repeats, n_docs, tokens, share, goal, short): the shares reached; 0 for sources without records.

    ``short`` is what the repeats don't allow of the goal.
    """
    sums = selected.groupBy("mix_id", "source_key").agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    joined = plans.join(sums, ["mix_id", "source_key"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return joined.select("mix_id", "source_key", "target_share", "max_repeats", "n_docs", "tokens", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("share"), F.round("goal", 3).alias("goal"), F.round(F.col("goal") - F.col("want"), 3).alias("short"))
