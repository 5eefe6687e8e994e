"""Analytics over logs: usage and cost, feedback, experiments, dashboards, tenancy, caches and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Price in dollars of a thousand tokens in and out, and quality tier of each model.
MODELS = {
    "extractive-stub": (0.0, 0.0, 0),
    "gemini-2.5-flash": (0.0, 0.0, 1),
    "gemini-2.0-flash": (0.0, 0.0, 1),
    "gemini-1.5-flash": (0.0, 0.0, 1),
    "gpt-4o-mini": (0.00015, 0.0006, 2),
    "gemini-1.5-pro": (0.00125, 0.005, 3),
    "gemini-2.5-pro": (0.00125, 0.010, 3),
    "claude-3-5-sonnet": (0.003, 0.015, 4),
    "gpt-4o": (0.005, 0.015, 5),
}


def latest_entries(logs: DataFrame) -> DataFrame:
    """Of the rows of one id the one received last; of equal times the one with a rating."""
    newest = Window.partitionBy("id").orderBy(F.col("received_at").desc_nulls_last(), F.col("rating").desc_nulls_last())
    return logs.where("id is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def price(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars for a call, to six places, halves up; 0 for unknown models.

    Prices are whole numbers of a hundred-millionth of a dollar for a token, so the sum is exact before it is rounded.
    """
    rate = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, v in MODELS.items() for x in (m, round(v[i] * 100_000))]), model), F.lit(0))
    return F.floor((tokens_in.cast("long") * rate(0) + tokens_out.cast("long") * rate(1) + 50) / 100) / 1_000_000


def usage_summary(events: DataFrame) -> DataFrame:
    """(model, operation, n_events, n_cached, hit_rate, cost) by model, by operation and in all (null where summed over).

    ``events`` has model, operation, cached and cost. Costs are summed and rounded once.
    """
    sums = events.groupingSets([["model"], ["operation"], []], "model", "operation")
    return sums.agg(F.count("*").alias("n_events"), F.count_if("cached").alias("n_cached"), F.round(F.count_if("cached") / F.count("*"), 4).alias("hit_rate"), F.round(F.sum("cost"), 6).alias("cost"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """One row: count, average (four places), high, low and the number of each rating from 1 to 5, zeros included."""
    rating = F.when(F.col("rating").between(1, 5), F.col("rating"))
    each = [F.count_if(rating == i).alias(f"rating_{i}") for i in range(1, 6)]
    return feedback.agg(F.count(rating).alias("n_rated"), F.round(F.avg(rating), 4).alias("average"), F.count_if(rating >= 4).alias("n_high"), F.count_if(rating <= 2).alias("n_low"), *each)


def feedback_patterns(feedback: DataFrame) -> DataFrame:
    """Cohort (high from 4, low to 2), n, avg_confidence, avg_sources (three places), number_share and the rules that fire.

    Signals are JSON; missing keys don't count in their averages.
    """
    signal = lambda k: F.get_json_object("signals", f"$.{k}")
    cohort = F.when(F.col("rating").between(4, 5), "high").when(F.col("rating").between(1, 2), "low")
    rows = feedback.select(cohort.alias("cohort"), F.expr("try_cast(get_json_object(signals, '$.confidence') as double)").alias("c"), F.expr("try_cast(get_json_object(signals, '$.source_count') as double)").alias("s"), (signal("has_numbers") == "true").alias("n")).where("cohort is not null")
    sums = rows.groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("c"), 3).alias("avg_confidence"), F.round(F.avg("s"), 3).alias("avg_sources"), F.round(F.count_if("n") / F.count("*"), 6).alias("number_share"))
    high, low = F.col("cohort") == "high", F.col("cohort") == "low"
    rules = F.array_compact(F.array(
        F.when(high & (F.col("avg_confidence") > 0.80), "confident"), F.when(high & (F.col("avg_sources") > 1.5), "many_sources"), F.when(high & (F.col("number_share") > 0.5), "numbers"),
        F.when(low & (F.col("avg_confidence") < 0.65), "raise_confidence"), F.when(low & (F.col("avg_sources") < 2), "require_sources"),
    ))
    return sums.withColumn("rules", F.array_join(rules, ","))


def insights(feedback: DataFrame) -> DataFrame:
    """One row: ratings in all, their average, the shares of high and low ones in percent, and the rules that ``feedback_patterns`` trips."""
    stats = feedback_stats(feedback)
    rules = feedback_patterns(feedback).agg(F.array_join(F.array_sort(F.filter(F.collect_set("rules"), lambda r: r != "")), ",").alias("recommendations"))
    percent = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("n_rated")) * 100, 1)
    shares = stats.select(F.col("n_rated").alias("total_feedback"), F.col("average").alias("average_rating"), percent("n_high").alias("high_rated_pct"), percent("n_low").alias("low_rated_pct"))
    return shares.crossJoin(F.broadcast(rules))


def variant_of(test: Column, user: Column, variants: list[str]) -> Column:
    """The variant, of the sorted ones, that the MD5 of "test:user" falls on."""
    digest = F.md5(F.concat(test, F.lit(":"), user).cast("binary"))
    n = len(variants)
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0).cast("long"), lambda a, i: (a * 16 + F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("long")) % n)
    return F.element_at(F.array(*map(F.lit, sorted(variants))), (rest + 1).cast("int"))


def experiment_results(results: DataFrame) -> DataFrame:
    """(test_id, variant, n, average, winner) with the best average as the test's winner, the first name on ties."""
    sums = results.groupBy("test_id", "variant").agg(F.count("rating").alias("n"), F.round(F.avg("rating"), 4).alias("average"))
    best = F.first("variant").over(Window.partitionBy("test_id").orderBy(F.col("average").desc_nulls_last(), "variant"))
    return sums.withColumn("winner", best)


def dashboard(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries, mean usable duration and confidence (of thousandths), rated ones, mean rating, providers and latest time."""
    usable = F.when((F.col("duration_ms") > 0) & ~F.isnan("duration_ms") & (F.col("duration_ms") < float("inf")), F.col("duration_ms"))
    provider = F.lower(F.trim("provider"))
    return logs.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"), F.round(F.avg(usable), 6).alias("avg_duration_ms"), (F.try_divide(F.sum(F.round(F.col("confidence") * 1000).cast("long")), F.count("confidence")) / 1000).alias("avg_confidence"), F.count("rating").alias("n_rated"),
        F.round(F.avg("rating"), 6).alias("avg_rating"), F.array_join(F.array_sort(F.collect_set(provider)), ",").alias("providers"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"),
    )


def histogram(rows: DataFrame, value: Column, bounds: list[float], labels: list[str]) -> DataFrame:
    """(labels..., le, n): counts of values up to each bound, as cumulative metric histograms have them; infinity last."""
    counted = [F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    sums = rows.groupBy(*labels).agg(*counted, F.count(value).alias("_all"))
    each = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n"))))
    return sums.select(*labels, each.alias("h")).select(*labels, "h.*")


def traces(spans: DataFrame) -> DataFrame:
    """(trace_id, root, n_spans, duration_ms, failed) of spans (trace_id, name, start, duration_ms, failed); the earliest is the root."""
    return spans.groupBy("trace_id").agg(F.min_by("name", F.struct("start", "name")).alias("root"), F.count("*").alias("n_spans"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"), F.bool_or("failed").alias("failed"))


def namespace_of(org: Column, team: Column, user: Column) -> Column:
    """org/team for members of a team, org for other members, user:id for the rest."""
    return F.when(org.isNotNull() & team.isNotNull(), F.concat(org, F.lit("/"), team)).when(org.isNotNull(), org).otherwise(F.concat(F.lit("user:"), user))


def tenant_usage(logs: DataFrame, members: DataFrame) -> DataFrame:
    """(org_slug, team_slug, n_users, n_queries) of members' queries, rolled up over teams and organisations.

    A member of several teams counts in each. Members are few and their table has repeated rows, which are one.
    """
    rows = logs.groupBy("user_id").agg(F.count("*").alias("n")).join(members.select("user_id", "org_slug", "team_slug").distinct(), "user_id")
    return rows.rollup("org_slug", "team_slug").agg(F.expr("cast(grouping_id() as int)").alias("level"), F.countDistinct("user_id").alias("n_users"), F.sum("n").alias("n_queries"))


def folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """The keys and what ``step`` gives for each row, in ``order``, of rules in which each row depends on the one before.

    ``step`` takes the state and the row's columns after the keys, and gives the next state and the result, whose columns
    ``schema`` names. Spark sorts the rows of a task, spilling where it must, and they stream through a state of constant
    size, so a key may have any number of them; but those of one key are one after the other by the rule's nature. A null
    key is a key of its own.
    """
    kinds, n = dict(rows.dtypes), len(keys)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if key != row[:n]:
                    key, state = row[:n], start()
                state, result = step(state, row[n:])
                out.append((*key, *result))
            yield pd.DataFrame(out, columns=names)

    # Keys as texts, in which a null is equal to itself.
    told = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), *(c for c in rows.columns if c not in keys))
    streamed = told.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, ", ".join([*(f"{k} string" for k in keys), schema]))
    return streamed.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), *names[n:])


def cache_hits(accesses: DataFrame, ttl: str) -> DataFrame:
    """Accesses (key, ts, id) with ``hit``: an entry is written on a miss and good until ``ttl`` after that, however often it is read.

    Misses restart the clock, so each depends on the one before, and entries live over midnight. A session window can't say
    that, as reads don't prolong an entry.
    """
    span = F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {ttl}")) * 1_000_000

    def step(since: int | None, row: tuple) -> tuple[int, tuple]:
        us, identity, life = row
        hit = since is not None and us - since <= life
        return since if hit else us, (identity, us, hit)

    rows = accesses.select("key", F.unix_micros("ts").alias("us"), "id", span.alias("life")).where("us is not null")
    out = folded(rows, ["key"], ["us", "id"], f"id {dict(accesses.dtypes)['id']}, us long, hit boolean", lambda: None, step)
    return out.select("key", "id", F.timestamp_micros("us").alias("ts"), "hit")


def budget_decisions(spending: DataFrame) -> DataFrame:
    """(key, day, seq, cost, accepted, spent) of costs (key, day, seq, cost, limit): one that would exceed the limit is rejected and not spent.

    A budget is one day's. Rejections feed back, so this is a fold and no running sum.
    """

    def step(spent: float, row: tuple) -> tuple[float, tuple]:
        seq, cost, limit = row
        after = round(spent + cost, 6)
        return (after, (seq, cost, True, after)) if after <= limit else (spent, (seq, cost, False, spent))

    rows = spending.select("key", "day", "seq", "cost", "limit").where("cost is not null and limit is not null")
    return folded(rows, ["key", "day"], ["seq"], f"seq {dict(spending.dtypes)['seq']}, cost double, accepted boolean, spent double", lambda: 0.0, step)


def breaker_states(calls: DataFrame, failures: int = 3, cooldown_s: int = 3600) -> DataFrame:
    """(key, seq, admitted, state) of calls (key, seq, ts, failed): closed, open after so many failures in a row, half open after the cooldown.

    An open breaker admits nothing until the cooldown is over, then one call that closes or opens it again.
    """

    def step(held: tuple[int, int | None], row: tuple) -> tuple[tuple[int, int | None], tuple]:
        s, seq, failed = row
        count, opened = held
        if opened is not None and s - opened < cooldown_s:
            return held, (seq, False, "open")
        trial = opened is not None
        count = count + 1 if failed else 0
        trips = failed and (trial or count >= failures)
        return (count, s if trips else None), (seq, True, "half_open" if trial else "closed")

    rows = calls.select("key", F.unix_seconds("ts").alias("s"), "seq", F.coalesce("failed", F.lit(False)).alias("failed")).where("s is not null")
    return folded(rows, ["key"], ["s", "seq"], f"seq {dict(calls.dtypes)['seq']}, admitted boolean, state string", lambda: (0, None), step)


def model_comparison(calls: DataFrame) -> DataFrame:
    """The columns of calls (tokens_in, tokens_out, ...) with each model, its cost and its place among the cheapest, equal costs in the models' order."""
    models = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("model")) for i, m in enumerate(MODELS)])).alias("m")
    each = calls.select("*", models).select(*calls.columns, "m.*").withColumn("cost", price(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))
    return each.withColumn("place", F.row_number().over(Window.partitionBy(*calls.columns).orderBy("cost", "i"))).drop("i")


def verified_keys(presented: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """(key, key_id, valid) of presented (key): whether its SHA-256 is that of a key (key_id, key_hash, revoked, expires_at) that is neither revoked nor expired."""
    joined = presented.select("key", F.sha2(F.col("key").cast("binary"), 256).alias("key_hash")).join(keys, "key_hash", "left")
    valid = F.col("key_id").isNotNull() & ~F.coalesce("revoked", F.lit(False)) & F.coalesce(F.col("expires_at") >= now, F.lit(True))
    return joined.select("key", "key_id", valid.alias("valid"))


def tenant_costs(events: DataFrame, members: DataFrame) -> DataFrame:
    """(org_slug, team_slug, level, n_queries, tokens, cost, n_cached, hit_rate) of usage events by members, rolled up over teams and organisations.

    Events are summed by user before they meet the memberships; a member of several teams counts in each.
    """
    sums = events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("t"), F.sum("cost").alias("c"), F.count_if("cached").alias("h"))
    rows = sums.join(members.select("user_id", "org_slug", "team_slug").distinct(), "user_id").rollup("org_slug", "team_slug")
    return rows.agg(F.expr("cast(grouping_id() as int)").alias("level"), F.sum("n").alias("n_queries"), F.sum("t").alias("tokens"), F.round(F.sum("c"), 6).alias("cost"), F.sum("h").alias("n_cached"), F.round(F.sum("h") / F.sum("n"), 4).alias("hit_rate"))


def filtered_log(rows: DataFrame, time: str, limit: int, equal: dict[str, object] | None = None, least: dict[str, float] | None = None, most: dict[str, float] | None = None, tie: str = "id") -> DataFrame:
    """The ``limit`` latest rows of a log for which the given columns are equal to, at least and at most the given values."""
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == F.lit(value))
    for name, value in (least or {}).items():
        rows = rows.where(F.col(name) >= value)
    for name, value in (most or {}).items():
        rows = rows.where(F.col(name) <= value)
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc()).limit(limit)


def without_organisations(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Memberships left when the organisations of ``gone`` (org_slug) are deleted with their teams and members."""
    return members.join(gone.select("org_slug").distinct(), "org_slug", "left_anti")


def index_tasks(documents: DataFrame, quality: Column, n_chunks: Column) -> DataFrame:
    """(id, status, step, progress, error, chunks) of the indexing of documents (id, text, ...): validated, judged, cut, embedded and put in.

    ``quality`` is a struct with ``action`` and ``score``. A blank text fails at 10 %, one that is rejected at 25 %.
    """
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    rejected = quality["action"] == "reject"
    failed = blank | rejected
    error = F.when(blank, "Text is empty").when(rejected, F.format_string("Quality too low (score %.2f)", quality["score"]))
    done = lambda a, b: F.when(failed, a).otherwise(b)
    return documents.select("id", done(F.lit("failed"), F.lit("completed")).alias("status"), done(F.lit("error"), F.lit("done")).alias("step"), F.when(blank, 10).when(rejected, 25).otherwise(100).alias("progress"), error.alias("error"), done(F.lit(0), n_chunks).alias("chunks"))


def recommended_model(budget: Column, tokens_in: Column, tokens_out: Column, prefer_quality: bool = True) -> Column:
    """The best (or cheapest) model whose call fits the budget, with its cost and tier; the stub where none does."""
    options = F.array(*[F.struct(F.lit(t).alias("tier"), (-price(F.lit(m), tokens_in, tokens_out)).alias("saved"), F.lit(-i).alias("order"), F.lit(m).alias("model")) for i, (m, (_, _, t)) in enumerate(MODELS.items())])
    fit = F.filter(options, lambda o: -o["saved"] <= budget)
    best = F.array_max(fit if prefer_quality else F.transform(fit, lambda o: F.struct(o["saved"].alias("saved"), (-o["tier"]).alias("neg"), o["order"].alias("order"), o["model"].alias("model"), o["tier"].alias("tier"))))
    return F.struct(F.coalesce(best["model"], F.lit("extractive-stub")).alias("model"), F.coalesce(-best["saved"], F.lit(0.0)).alias("cost"), F.coalesce(best["tier"], F.lit(0)).alias("tier"))


def cache_savings(total: Column, hit_rate: Column, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """original_cost, with_cache_cost, savings and new_queries of a cache with the given hit rate."""
    each = price(model, tokens_in, tokens_out)
    new = F.bround(total * (1 - hit_rate), 0)
    return F.struct(F.round(each * total, 6).alias("original_cost"), F.round(each * new, 6).alias("with_cache_cost"), F.round(each * (total - new), 6).alias("savings"), new.cast("long").alias("new_queries"))
