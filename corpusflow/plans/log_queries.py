"""Queries over logs: usage, cost, feedback, experiments, dashboards, tenants, caches and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import analytics as A
from corpusflow.operators.rerank import most_recent
from corpusflow.plans.registry import Tables, query

LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, rating DESC NULLS LAST) AS n FROM query_logs WHERE id IS NOT NULL) WHERE n = 1)"""
MODEL = {"stub": "extractive-stub", "gemini": "gemini-2.5-pro", "openai": "gpt-4o", "claude": "claude-3-5-sonnet", "local": "extractive-stub"}
MODEL_SQL = "CASE lower(trim(provider)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL.items()) + " END"
PRICE_SQL = {i: "CASE model " + " ".join(f"WHEN '{m}' THEN {round(v[i] * 100_000)}" for m, v in A.MODELS.items()) + " ELSE 0 END" for i in (0, 1)}


def latest(t: Tables) -> DataFrame:
    return A.latest_entries(t.query_logs)


def usage(t: Tables) -> DataFrame:
    """(id, user_id, created_at, model, operation, tokens_in, tokens_out, cached, cost): the log as usage events; quick answers count as cached."""
    model = F.create_map(*[F.lit(x) for kv in MODEL.items() for x in kv])[F.lower(F.trim("provider"))]
    cached = F.coalesce(F.col("duration_ms") < 300, F.lit(False))
    rows = latest(t).where("provider is not null").select(
        "id", "user_id", "created_at", model.alias("model"), F.when(F.col("sources_count") > 4, "search").otherwise("answer").alias("operation"),
        F.greatest(F.lit(1), F.floor(F.length(F.coalesce("question", F.lit(""))) / 4)).alias("tokens_in"), F.greatest(F.lit(1), F.floor(F.length(F.coalesce("answer", F.lit(""))) / 4)).alias("tokens_out"), cached.alias("cached"),
    )
    return rows.withColumn("cost", F.when(F.col("cached"), 0.0).otherwise(A.price(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))))


USAGE = f"""{LATEST},
u0 AS (SELECT id, user_id, created_at, {MODEL_SQL} AS model, CASE WHEN sources_count > 4 THEN 'search' ELSE 'answer' END AS operation, greatest(1, length(coalesce(question, '')) // 4) AS tokens_in,
   greatest(1, length(coalesce(answer, '')) // 4) AS tokens_out, coalesce(duration_ms < 300 AND NOT isnan(duration_ms), false) AS cached FROM latest WHERE provider IS NOT NULL),
usage AS (SELECT *, CASE WHEN cached THEN 0.0 ELSE (tokens_in * {PRICE_SQL[0]} + tokens_out * {PRICE_SQL[1]} + 50) // 100 / 1000000.0 END::DOUBLE AS cost FROM u0)"""


@query(f"""WITH {USAGE} SELECT model, operation, count(*) AS n_events, count_if(cached)::BIGINT AS n_cached, round(count_if(cached) / count(*)::DOUBLE, 4) AS hit_rate, round(sum(cost), 6) AS cost
FROM usage GROUP BY GROUPING SETS ((model), (operation), ())""")
def usage_summary(t: Tables) -> DataFrame:
    """Events, cache hits and cost by model, by operation and in all."""
    return A.usage_summary(usage(t))


@query(f"WITH {USAGE} SELECT user_id, count(*) AS n_events, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost FROM usage GROUP BY user_id")
def usage_by_user(t: Tables) -> DataFrame:
    """Each user's tokens and cost."""
    return usage(t).groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


@query(f"""WITH {USAGE}, r AS (SELECT user_id, id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS seen_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM usage WHERE user_id IS NOT NULL)
SELECT user_id, id, seen_at FROM r WHERE n <= 20""")
def recent_history(t: Tables) -> DataFrame:
    """The twenty latest entries of each user."""
    rows = usage(t).where("user_id is not null")
    return most_recent(rows, ["user_id"], "created_at", 20).select("user_id", "id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


DISTINCT_FEEDBACK = "fb AS (SELECT DISTINCT id, rating, signals FROM feedback_records WHERE id IS NOT NULL)"


def feedback(t: Tables) -> DataFrame:
    return t.feedback_records.where("id is not null").select("id", "rating", "signals").distinct()


@query(f"""WITH {DISTINCT_FEEDBACK}, r AS (SELECT CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating FROM fb)
SELECT count(rating) AS n_rated, round(avg(rating), 4) AS average, count_if(rating >= 4)::BIGINT AS n_high, count_if(rating <= 2)::BIGINT AS n_low, {', '.join(f'count_if(rating = {i})::BIGINT AS rating_{i}' for i in range(1, 6))} FROM r""")
def feedback_statistics(t: Tables) -> DataFrame:
    """Counts and average of ratings."""
    return A.feedback_stats(feedback(t))


@query(f"""WITH {DISTINCT_FEEDBACK}, c AS (SELECT CASE WHEN rating BETWEEN 4 AND 5 THEN 'high' WHEN rating BETWEEN 1 AND 2 THEN 'low' END AS cohort, try_cast(json_extract_string(signals, '$.confidence') AS DOUBLE) AS c,
  try_cast(json_extract_string(signals, '$.source_count') AS DOUBLE) AS s, json_extract_string(signals, '$.has_numbers') = 'true' AS n FROM fb),
g AS (SELECT cohort, count(*) AS n, round(avg(c), 3) AS avg_confidence, round(avg(s), 3) AS avg_sources, round(count_if(n) / count(*)::DOUBLE, 6) AS number_share FROM c WHERE cohort IS NOT NULL GROUP BY cohort)
SELECT *, array_to_string(list_filter([CASE WHEN cohort = 'high' AND avg_confidence > 0.8 THEN 'confident' END, CASE WHEN cohort = 'high' AND avg_sources > 1.5 THEN 'many_sources' END, CASE WHEN cohort = 'high' AND number_share > 0.5 THEN 'numbers' END,
  CASE WHEN cohort = 'low' AND avg_confidence < 0.65 THEN 'raise_confidence' END, CASE WHEN cohort = 'low' AND avg_sources < 2 THEN 'require_sources' END], lambda x: x IS NOT NULL), ',') AS rules FROM g""")
def feedback_patterns(t: Tables) -> DataFrame:
    """Signals of well and badly rated answers and the rules that they trip."""
    return A.feedback_patterns(feedback(t))


# A hexadecimal number's remainder by three is that of its digits' sum.
@query("""WITH u AS (SELECT DISTINCT user_id FROM feedback_records WHERE user_id IS NOT NULL)
SELECT user_id, ['blend', 'classic', 'fresh'][(list_sum(list_transform(range(1, 33), lambda i: ('0x' || substr(md5('ranking:' || user_id), i::INT, 1))::INT)) % 3 + 1)::INT] AS variant FROM u""")
def experiment_variants(t: Tables) -> DataFrame:
    """The variant of each user in an experiment."""
    users = t.feedback_records.where("user_id is not null").select("user_id").distinct()
    return users.select("user_id", A.variant_of(F.lit("ranking"), F.col("user_id"), ["blend", "classic", "fresh"]).alias("variant"))


@query("""WITH r AS (SELECT DISTINCT id, CASE WHEN array_length(tags) > 0 THEN tags[1] ELSE 'none' END AS variant, strftime(submitted_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS test_id, rating FROM feedback_records WHERE rating BETWEEN 1 AND 5 AND id IS NOT NULL AND tags IS NOT NULL),
s AS (SELECT test_id, variant, count(rating) AS n, round(avg(rating), 4) AS average FROM r GROUP BY ALL)
SELECT *, first_value(variant) OVER (PARTITION BY test_id ORDER BY average DESC NULLS LAST, variant) AS winner FROM s""")
def experiment_results(t: Tables) -> DataFrame:
    """Average rating by first tag and day, with the day's best tag."""
    rows = t.feedback_records.where("rating between 1 and 5 and id is not null and tags is not null")
    variant = F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("none"))
    return A.experiment_results(rows.select("id", variant.alias("variant"), F.date_format("submitted_at", "yyyy-MM-dd").alias("test_id"), "rating").distinct())


def _dashboard_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {LATEST} SELECT {by + ',' if by else ''} count(*) AS n_queries, round(avg(CASE WHEN duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms) THEN duration_ms END), 6) AS avg_duration_ms, sum(round(confidence * 1000)::BIGINT) / count(confidence) / 1000.0 AS avg_confidence,
  count(rating) AS n_rated, round(avg(rating), 6) AS avg_rating, coalesce(string_agg(DISTINCT lower(trim(provider)), ',' ORDER BY lower(trim(provider))), '') AS providers, strftime(max(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS latest FROM latest {group}"""


@query(_dashboard_sql(""))
def dashboard(t: Tables) -> DataFrame:
    """The log in one row."""
    return A.dashboard(latest(t))


@query(_dashboard_sql("user_id"))
def dashboard_by_user(t: Tables) -> DataFrame:
    """The log by user."""
    return A.dashboard(latest(t), ["user_id"])


@query("""WITH e AS (SELECT DISTINCT id, lower(trim(provider)) AS provider, duration_ms FROM query_logs WHERE id IS NOT NULL AND provider IS NOT NULL AND duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms)),
b AS (SELECT unnest(['500.0', '1000.0', '5000.0', '+Inf']) AS le, unnest([500.0, 1000.0, 5000.0, 'Infinity'::DOUBLE]) AS bound)
SELECT provider, le, count_if(duration_ms <= bound)::BIGINT AS n FROM e, b GROUP BY provider, le""")
def latency_histogram(t: Tables) -> DataFrame:
    """Cumulative histogram of durations by provider."""
    ok = (F.col("duration_ms") > 0) & ~F.isnan("duration_ms") & (F.col("duration_ms") < float("inf")) & F.col("id").isNotNull() & F.col("provider").isNotNull()
    rows = t.query_logs.where(ok).select("id", F.lower(F.trim("provider")).alias("provider"), "duration_ms").distinct()
    return A.histogram(rows, F.col("duration_ms"), [500.0, 1000.0, 5000.0], ["provider"])


@query("""SELECT user_id AS trace_id, min_by(event_type, ts::VARCHAR || event_type) AS root, count(*) AS n_spans, round(sum(value), 3) AS duration_ms, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id""")
def trace_summaries(t: Tables) -> DataFrame:
    """Each user's events as one trace."""
    e = t.events.select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), F.col("ts").alias("start"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("failed"))
    return A.traces(e)


@query("""WITH m AS (SELECT DISTINCT user_id, org_slug, team_slug FROM members), u AS (SELECT user_id, count(DISTINCT id) AS n FROM query_logs GROUP BY user_id)
SELECT org_slug, team_slug, grouping(org_slug, team_slug)::INT AS level, count(DISTINCT user_id) AS n_users, sum(n)::BIGINT AS n_queries FROM m JOIN u USING (user_id) GROUP BY ROLLUP (org_slug, team_slug)""")
def tenant_usage(t: Tables) -> DataFrame:
    """Users and queries of each team, organisation and in all."""
    return A.tenant_usage(t.query_logs.where("id is not null").select("id", "user_id").distinct(), t.members)


@query("""WITH m AS (SELECT DISTINCT user_id, org_slug, team_slug FROM members), u AS (SELECT DISTINCT user_id FROM query_logs WHERE user_id IS NOT NULL)
SELECT namespace, count(*) AS n_users FROM (SELECT u.user_id, CASE WHEN org_slug IS NOT NULL AND team_slug IS NOT NULL THEN org_slug || '/' || team_slug WHEN org_slug IS NOT NULL THEN org_slug ELSE 'user:' || u.user_id END AS namespace FROM u LEFT JOIN m USING (user_id)) GROUP BY namespace""")
def resolved_namespaces(t: Tables) -> DataFrame:
    """How many users each namespace resolves for."""
    users = t.query_logs.where("user_id is not null").select("user_id").distinct()
    joined = users.join(t.members.select("user_id", "org_slug", "team_slug").distinct(), "user_id", "left")
    return joined.groupBy(A.namespace_of(F.col("org_slug"), F.col("team_slug"), F.col("user_id")).alias("namespace")).agg(F.count("*").alias("n_users"))


@query("""SELECT event_type, sum(n)::BIGINT AS n_events FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type = 'error' OR value > 100 GROUP BY event_type) GROUP BY event_type""")
def error_patterns(t: Tables) -> DataFrame:
    """Events of each type that failed or took long."""
    return t.events.where("event_type = 'error' or value > 100").groupBy("event_type").agg(F.count("*").alias("n_events"))


@query("""WITH RECURSIVE a AS (SELECT event_type || ':' || (user_id % 40) AS key, ts::DATE AS day, event_id AS id, ts, row_number() OVER (PARTITION BY event_type || ':' || (user_id % 40) ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT key, day, id, i, ts AS since, false AS hit FROM a WHERE i = 1
      UNION ALL SELECT a.key, a.day, a.id, a.i, CASE WHEN a.ts - f.since <= INTERVAL 2 HOUR THEN f.since ELSE a.ts END, a.ts - f.since <= INTERVAL 2 HOUR FROM f JOIN a ON a.key = f.key AND a.i = f.i + 1)
SELECT key, strftime(day, '%Y-%m-%d') AS day, count(*) AS n, count_if(hit)::BIGINT AS n_hits, round(count_if(hit) / count(*)::DOUBLE, 4) AS hit_rate FROM f GROUP BY ALL""")
def cache_hit_rates(t: Tables) -> DataFrame:
    """Hit rate by key and day of a cache of two hours over the events' accesses."""
    key = F.concat("event_type", F.lit(":"), F.col("user_id") % 40)
    hits = A.cache_hits(t.events.select(key.alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id")), "2 hours")
    return hits.groupBy("key", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"), F.round(F.count_if("hit") / F.count("*"), 4).alias("hit_rate"))


@query("""WITH RECURSIVE a AS (SELECT user_id AS key, ts::DATE AS day, event_id AS seq, round(value, 2) AS cost, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS i FROM events),
f AS (SELECT key, day, seq, cost, i, cost <= 100 AS accepted, CASE WHEN cost <= 100 THEN cost ELSE 0.0 END AS spent FROM a WHERE i = 1
      UNION ALL SELECT a.key, a.day, a.seq, a.cost, a.i, round(f.spent + a.cost, 6) <= 100, CASE WHEN round(f.spent + a.cost, 6) <= 100 THEN round(f.spent + a.cost, 6) ELSE f.spent END FROM f JOIN a ON a.key = f.key AND a.day = f.day AND a.i = f.i + 1)
SELECT key, strftime(day, '%Y-%m-%d') AS day, seq, accepted, round(spent, 6) AS spent FROM f""")
def budget_decisions(t: Tables) -> DataFrame:
    """Which events a daily budget of 100 for each user lets through."""
    rows = t.events.select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.round("value", 2).alias("cost"), F.lit(100.0).alias("limit"))
    return A.budget_decisions(rows).select("key", F.date_format("day", "yyyy-MM-dd").alias("day"), "seq", "accepted", F.round("spent", 6).alias("spent"))


@query("""WITH RECURSIVE a AS (SELECT user_id AS key, event_id, epoch(ts)::BIGINT AS s, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS i FROM events),
f AS (SELECT key, i, CASE WHEN failed THEN s END AS opened, true AS admitted, 'closed' AS state FROM a WHERE i = 1
      UNION ALL SELECT a.key, a.i, CASE WHEN f.opened IS NOT NULL AND a.s - f.opened < 3600 THEN f.opened WHEN a.failed THEN a.s END, NOT coalesce(a.s - f.opened < 3600, false),
        CASE WHEN f.opened IS NULL THEN 'closed' WHEN a.s - f.opened < 3600 THEN 'open' ELSE 'half_open' END FROM f JOIN a ON a.key = f.key AND a.i = f.i + 1)
SELECT state, admitted, count(*) AS n_calls FROM f GROUP BY ALL""")
def breaker_states(t: Tables) -> DataFrame:
    """How a circuit breaker for each user, which opens on one error, would have treated the events."""
    rows = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return A.breaker_states(rows, 1).groupBy("state", "admitted").agg(F.count("*").alias("n_calls"))


def _model_sql() -> str:
    options = " UNION ALL ".join(f"SELECT id, '{m}' AS model, {t} AS tier, ((tokens_in * {round(a * 100_000)} + tokens_out * {round(b * 100_000)} + 50) // 100 / 1000000.0)::DOUBLE AS cost, {i} AS o FROM usage" for i, (m, (a, b, t)) in enumerate(A.MODELS.items()))
    return f"WITH {USAGE}, o AS ({options}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier DESC, cost, o) AS n FROM o WHERE cost <= 0.0008) SELECT id, model, cost, tier FROM r WHERE n = 1"


@query(_model_sql())
def recommended_models(t: Tables) -> DataFrame:
    """The best model for each entry at 0.0008 dollars a call."""
    m = A.recommended_model(F.lit(0.0008), F.col("tokens_in"), F.col("tokens_out"))
    return usage(t).select("id", m.alias("m")).select("id", "m.*")


@query(f"""WITH {USAGE}, s AS (SELECT model, count(*) AS total, count_if(cached) / count(*)::DOUBLE AS hit_rate, avg(tokens_in)::INT AS ti, avg(tokens_out)::INT AS tout FROM usage GROUP BY model),
c AS (SELECT *, ((ti * {PRICE_SQL[0]} + tout * {PRICE_SQL[1]} + 50) // 100 / 1000000.0)::DOUBLE AS each FROM s)
SELECT model, round(each * total, 6) AS original_cost, round(each * (total * (1 - hit_rate))::BIGINT, 6) AS with_cache_cost, (total * (1 - hit_rate))::BIGINT AS new_queries FROM c""")
def cache_savings(t: Tables) -> DataFrame:
    """What the cache saves by model."""
    sums = usage(t).groupBy("model").agg(F.count("*").alias("total"), (F.count_if("cached") / F.count("*")).alias("hit_rate"), F.bround(F.avg("tokens_in")).alias("ti"), F.bround(F.avg("tokens_out")).alias("tout"))
    saved = A.cache_savings(F.col("total"), F.col("hit_rate"), F.col("model"), F.col("ti"), F.col("tout"))
    return sums.select("model", saved.alias("s")).select("model", "s.original_cost", "s.with_cache_cost", "s.new_queries")


@query("""WITH q AS (SELECT DISTINCT id, user_id FROM query_logs WHERE id IS NOT NULL AND user_id IS NOT NULL), f AS (SELECT DISTINCT id, user_id FROM feedback_records WHERE id IS NOT NULL AND user_id IS NOT NULL), m AS (SELECT DISTINCT user_id, org_slug, team_slug FROM members)
SELECT user_id, count_if(k = 'q')::BIGINT AS n_queries, count_if(k = 'f')::BIGINT AS n_feedback, count_if(k = 'm')::BIGINT AS n_memberships FROM (SELECT user_id, 'q' AS k FROM q UNION ALL SELECT user_id, 'f' FROM f UNION ALL SELECT user_id, 'm' FROM m) GROUP BY user_id""")
def personal_data_inventory(t: Tables) -> DataFrame:
    """Rows that each user has in each table."""
    part = lambda d, k: d.select("user_id", F.lit(k).alias("k"))
    q = t.query_logs.where("id is not null and user_id is not null").select("id", "user_id").distinct()
    f = t.feedback_records.where("id is not null and user_id is not null").select("id", "user_id").distinct()
    m = t.members.select("user_id", "org_slug", "team_slug").distinct()
    rows = part(q, "q").unionByName(part(f, "f")).unionByName(part(m, "m"))
    return rows.groupBy("user_id").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("q", "n_queries"), ("f", "n_feedback"), ("m", "n_memberships"))])


@query("""SELECT user_id, sha256(user_id || ':' || org_slug) AS key_hash, left(sha256(user_id || ':' || org_slug), 8) AS prefix, max(joined_at) < TIMESTAMPTZ '2019-01-01 00:00:00+00' AS expired FROM members WHERE user_id IS NOT NULL AND org_slug IS NOT NULL GROUP BY user_id, org_slug""")
def api_keys(t: Tables) -> DataFrame:
    """A key's hash and prefix for each membership and whether it has expired."""
    digest = F.sha2(F.concat("user_id", F.lit(":"), "org_slug"), 256)
    rows = t.members.where("user_id is not null and org_slug is not null").groupBy("user_id", "org_slug").agg(F.max("joined_at").alias("joined_at"))
    return rows.select("user_id", digest.alias("key_hash"), F.left(digest, F.lit(8)).alias("prefix"), (F.col("joined_at") < F.lit("2019-01-01 00:00:00").cast("timestamp")).alias("expired"))


@query("""WITH p AS (SELECT f.id, coalesce(nullif(trim(f.answer), ''), nullif(trim(l.answer), ''), 'no answer') AS answer, CASE WHEN nullif(trim(f.answer), '') IS NOT NULL THEN 1 WHEN nullif(trim(l.answer), '') IS NOT NULL THEN 2 ELSE 3 END AS depth
 FROM (SELECT DISTINCT id, query_id, answer FROM feedback_records WHERE id IS NOT NULL) f LEFT JOIN (SELECT DISTINCT id, answer FROM query_logs) l ON l.id = f.query_id)
SELECT depth, depth > 1 AS degraded, count(*) AS n FROM p GROUP BY ALL""")
def fallback_depths(t: Tables) -> DataFrame:
    """How far a cascade of answers - the feedback's, the log's, a fixed one - has to go."""
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    f = t.feedback_records.where("id is not null").select("id", "query_id", F.col("answer").alias("a")).distinct()
    l = t.query_logs.select(F.col("id").alias("query_id"), F.col("answer").alias("b")).distinct()  # noqa: E741
    depth = F.when(told("a").isNotNull(), 1).when(told("b").isNotNull(), 2).otherwise(3)
    return f.join(l, "query_id", "left").groupBy(depth.alias("depth")).agg(F.count("*").alias("n")).select("depth", (F.col("depth") > 1).alias("degraded"), "n")
