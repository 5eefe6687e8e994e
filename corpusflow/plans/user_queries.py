"""Queries over users' histories, similar questions, multi-part questions, indexing queues and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.keys import source_key
from corpusflow.operators import context as C
from corpusflow.operators import ranking as R
from corpusflow.operators import search as S
from corpusflow.operators.rerank import most_recent
from corpusflow.operators.store import index_type
from corpusflow.plans.corpus_queries import LAST, last
from corpusflow.plans.log_queries import LATEST, latest
from corpusflow.plans.registry import Tables, query
from corpusflow.plans.search_queries import _hashed, texts
from corpusflow.plans.text_queries import STRIP, TOKENS, questions

def history(t: Tables, n: int) -> DataFrame:
    """(user_id, id, question, created_at) of each user's ``n`` latest entries."""
    rows = latest(t).where("user_id is not null and question is not null").select("user_id", "id", "question", "created_at")
    return most_recent(rows, ["user_id"], "created_at", n)


def _interests_sql() -> str:
    union = " UNION ALL ".join(f"SELECT '{k}' AS topic, unnest([{', '.join(repr(p) for p in v)}]) AS phrase" for k, v in X.TOPICS.items())
    return f"""WITH {LATEST}, h AS (SELECT user_id, id, lower(question) AS q FROM latest WHERE user_id IS NOT NULL AND question IS NOT NULL),
k AS ({union}), m AS (SELECT DISTINCT user_id, id, topic FROM h JOIN k ON contains(h.q, k.phrase)), c AS (SELECT user_id, topic, count(*) AS n FROM m GROUP BY ALL)
SELECT user_id, topic, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, topic)::INT AS rank FROM c) WHERE rank <= 3"""


def interests(t: Tables) -> DataFrame:
    rows = latest(t).where("user_id is not null and question is not null")
    counted = rows.select("user_id", F.explode(X.topics(F.col("question"))).alias("topic")).groupBy("user_id", "topic").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "topic"))).where("rank <= 3")


@query(_interests_sql())
def user_interests(t: Tables) -> DataFrame:
    """The three topics that each user asked about most, over all entries."""
    return interests(t)


@query()
def recommended_documents(t: Tables) -> DataFrame:
    """Five documents for each user whose number is divisible by 50, near what they last asked and are interested in."""
    chosen = F.try_to_number(F.regexp_extract("user_id", r"(\d+)$", 1), F.lit("999999999")) % 50 == 0
    recent = history(t, 5).where(chosen).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "question"))), lambda x: x["question"]), " ").alias("asked"))
    about = interests(t).where(chosen).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]), " ").alias("topics"))
    pseudo = recent.join(about, "user_id", "left").select(F.col("user_id").alias("id"), F.concat_ws(" ", "asked", "topics").alias("text"))
    found = S.cosine_top_k(S.hashed_vectors(pseudo), S.hashed_vectors(texts(t)), 5)
    return found.select(F.col("query_id").alias("user_id"), F.col("id").cast("long").alias("doc_id"), "score", "rank")


@query(f"""WITH fr AS (SELECT DISTINCT id, query_id, query_text AS text FROM feedback_records WHERE id IS NOT NULL), qs AS (SELECT DISTINCT id, question AS text FROM query_logs WHERE id IS NOT NULL AND id IN (SELECT query_id FROM fr)),{_hashed('a', 'fr', 'id')},{_hashed('b', 'qs', 'id')},
s AS (SELECT fr.id, fr.query_id, round(coalesce(sum(a.value * b.value), 0), 6) + 0.0 AS score FROM fr JOIN (SELECT DISTINCT id FROM a) x ON x.id = fr.id JOIN (SELECT DISTINCT id FROM b) y ON y.id = fr.query_id LEFT JOIN a ON a.id = fr.id LEFT JOIN b ON b.id = fr.query_id AND b.idx = a.idx GROUP BY fr.id, fr.query_id)
SELECT id, score, CASE WHEN score >= 0.85 THEN 'very similar' WHEN score >= 0.65 THEN 'similar' WHEN score >= 0.45 THEN 'moderate' WHEN score >= 0.2 THEN 'dissimilar' ELSE 'very different' END AS band FROM s""")
def question_similarity(t: Tables) -> DataFrame:
    """How near each feedback's query text is to the logged question, and what that means."""
    rows = t.feedback_records.where("id is not null").select("id", "query_id", F.col("query_text").alias("text")).distinct()
    asked = questions(t).select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    a = S.hashed_vectors(rows.select("id", "text")).withColumnRenamed("vector", "a")
    b = S.hashed_vectors(asked.join(rows.select("query_id").distinct(), "query_id", "left_semi"), "query_id").withColumnRenamed("vector", "b")
    score = F.round(S.cosine(F.col("a"), F.col("b")), 6)
    return rows.select("id", "query_id").join(a, "id").join(b, "query_id").select("id", score.alias("score"), X.similarity_band(score).alias("band"))


def asked_sample(rows: DataFrame) -> DataFrame:
    """The query set of a search by logged questions, about every fiftieth: entries whose id's hash starts with a byte below five."""
    return rows.where(F.substring(F.md5(F.col("id").cast("binary")), 1, 2) < "05")


@query()
def multi_hop_answers(t: Tables) -> DataFrame:
    """Answers to the query set's logged questions of two parts or more: each part is searched and answered, and the answers joined."""
    several = asked_sample(questions(t)).where("question is not null").select("id", X.decompose(F.col("question")).alias("parts")).where(F.size("parts") > 1)
    parts = several.select("id", F.posexplode("parts").alias("pos", "part"))
    asked = parts.select(F.concat_ws("#", "id", "pos").alias("query_id"), "id", "pos", F.col("part").alias("query"), X.keywords(F.col("part")).alias("terms"))
    hits = S.search_texts(asked, texts(t), 3).join(texts(t).select("id", "text"), "id")
    told = C.extractive_answers(hits, asked.select("query_id", "query"))
    rows = told.withColumnsRenamed({"id": "doc_id"}).join(asked.select("query_id", "id", "pos"), "query_id")
    return R.synthesized(rows.select(F.col("id").alias("query_id"), F.col("pos").cast("string").alias("branch"), F.lit(1).alias("pos"), "answer"))


@query(rf"""
WITH f AS (SELECT DISTINCT id, replace(answer, chr(10), ' ') AS a, list_distinct(list_filter({TOKENS.format('query_text')}, lambda x: length(x) > 3)) AS kw FROM feedback_records WHERE id IS NOT NULL AND answer IS NOT NULL AND query_text IS NOT NULL),
s AS (SELECT id, a, kw, list_filter(list_transform(string_split(a, '. '), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ss FROM f),
u AS (SELECT id, a, kw, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s),
n AS (SELECT *, len(list_filter(kw, lambda w: contains(lower(s), w))) AS n FROM u), b AS (SELECT *, row_number() OVER (PARTITION BY id, a ORDER BY n DESC, i) AS k FROM n)
SELECT s.id, left(CASE WHEN b.n > 0 THEN b.s ELSE s.a END, 300) AS highlight FROM s LEFT JOIN b ON s.id = b.id AND s.a = b.a AND b.k = 1""")
def keyword_highlights(t: Tables) -> DataFrame:
    """The part of each feedback's answer that holds most of its query's longer words."""
    rows = t.feedback_records.where("id is not null and answer is not null and query_text is not null").select("id", F.replace("answer", F.lit("\n"), F.lit(" ")).alias("a"), "query_text").distinct()
    wanted = F.array_distinct(F.filter(X.tokens(F.col("query_text")), lambda w: F.length(w) > 3))
    cut = F.filter(F.transform(F.split("a", r"\. "), lambda s: X.strip(s)), lambda s: s != "")
    scored = F.transform(cut, lambda s, i: F.struct(F.size(F.filter(wanted, lambda w: F.contains(F.lower(s), w))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(scored)
    return rows.select("id", F.substring(F.when(best["n"] > 0, best["s"]).otherwise(F.col("a")), 1, 300).alias("highlight"))


@query(f"""WITH {LATEST} SELECT id, sha1(coalesce(lower(trim(provider)), '') || '|' || trim(regexp_replace(coalesce(question, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS cache_key FROM latest""")
def answer_cache_keys(t: Tables) -> DataFrame:
    """The key under which each answer would be cached."""
    key = F.concat(F.coalesce(F.lower(F.trim("provider")), F.lit("")), F.lit("|"), X.normalize_query(F.coalesce("question", F.lit(""))))
    return latest(t).select("id", F.sha1(key.cast("binary")).alias("cache_key"))


@query(f"""WITH {LATEST}, k AS (SELECT id, created_at, trim(regexp_replace(lower(coalesce(question, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS q FROM latest),
g AS (SELECT *, lag(created_at) OVER (PARTITION BY q ORDER BY created_at, id) AS before FROM k) SELECT count(*) AS n_entries, count_if(created_at - before <= INTERVAL 6 HOUR)::BIGINT AS n_repeats FROM g""")
def repeated_questions(t: Tables) -> DataFrame:
    """Entries whose question, white space and case aside, was asked within the six hours before."""
    span = 6 * 3_600_000_000
    asked = latest(t).select(F.unix_micros("created_at").alias("us"), X.normalize_query(F.lower(F.coalesce("question", F.lit("")))).alias("q"))
    # Within six hours from one start all but the first are repeats; the first is one if the last of the six hours before is near enough.
    spans = asked.groupBy("q", F.floor(F.col("us") / span).alias("span")).agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.count("us").alias("dated"))
    before = F.lag("last").over(Window.partitionBy("q").orderBy("span"))
    linked = F.coalesce(F.col("first") - before <= span, F.lit(False)).cast("long")
    repeats = F.when(F.col("dated") > 0, F.col("dated") - 1 + linked).otherwise(0)
    return spans.withColumn("repeats", repeats).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("n_repeats"))


@query(f"""WITH {LATEST} SELECT user_id, count(*) AS n_kept FROM latest WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM members WHERE role = 'viewer' AND user_id IS NOT NULL) GROUP BY user_id""")
def personal_data_erased(t: Tables) -> DataFrame:
    """What each user has left in the log after the entries of viewers were erased; feedback stays, as is the rule."""
    gone = t.members.where("role = 'viewer' and user_id is not null").select("user_id").distinct()
    return latest(t).where("user_id is not null").join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n_kept"))


PRIORITY = {"error": 0, "purchase": 1, "signup": 1}
PRIORITY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 2 END"


@query(f"""SELECT event_id, {PRIORITY_SQL} AS priority, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY {PRIORITY_SQL}, event_id)::INT AS place FROM events""")
def queue_order(t: Tables) -> DataFrame:
    """The place of each event in its day's queue, by priority and then arrival."""
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    rows = t.events.select("event_id", F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(2)).alias("priority"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return R.places(rows, "day", ["priority", "event_id"]).select("event_id", "priority", "day", F.col("place").cast("int").alias("place"))


@query("""SELECT event_type AS status, count(*) AS n_tasks, round(avg(value), 6) AS avg_run, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def queue_statistics(t: Tables) -> DataFrame:
    """Tasks by status with mean run time and share."""
    sums = t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n_tasks"), F.round(F.avg("value"), 6).alias("avg_run"))
    # A handful of rows, one for each status.
    return sums.withColumn("share", F.round(F.col("n_tasks") / F.sum("n_tasks").over(Window.partitionBy(F.lit(1))), 6))


@query(f"""WITH {LATEST}, a AS (SELECT id, string_split(answer, ' ') AS w FROM latest WHERE answer IS NOT NULL), u AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM a)
SELECT id, count(*) AS n_steps, sum(length(word) + 1)::BIGINT AS n_chars, min(CASE WHEN i = 1 THEN word END) AS first_word FROM u GROUP BY id""")
def answer_stream_steps(t: Tables) -> DataFrame:
    """How many steps of a word and a blank each answer is streamed in."""
    steps = latest(t).where("answer is not null").select("id", F.posexplode(F.split("answer", " ")).alias("i", "word"))
    return steps.groupBy("id").agg(F.count("*").alias("n_steps"), F.sum(F.length("word") + 1).alias("n_chars"), F.min(F.when(F.col("i") == 0, F.col("word"))).alias("first_word"))


@query(LAST + """, s AS (SELECT store_name, count(*) AS n_vectors, count(DISTINCT namespace) AS n_namespaces FROM last GROUP BY store_name)
SELECT store_name, n_vectors, n_namespaces, CASE WHEN n_vectors < 10000 THEN 'flat' WHEN n_vectors < 1000000 THEN 'hnsw' ELSE 'ivf' END AS suggested_index, array_to_string(list_filter([CASE WHEN n_vectors >= 10000 THEN 'reindex' END, CASE WHEN n_namespaces > 20 THEN 'compact' END, 'analyse'], lambda x: x IS NOT NULL), ',') AS actions FROM s""")
def maintenance_plan(t: Tables) -> DataFrame:
    """What upkeep each store, taken as a flat index, needs."""
    sums = last(t).groupBy("store_name").agg(F.count("*").alias("n_vectors"), F.countDistinct("namespace").alias("n_namespaces"))
    actions = F.array_compact(F.array(F.when(F.col("n_vectors") >= 10_000, "reindex"), F.when(F.col("n_namespaces") > 20, "compact"), F.lit("analyse")))
    return sums.select("store_name", "n_vectors", "n_namespaces", index_type(F.col("n_vectors")).alias("suggested_index"), F.array_join(actions, ",").alias("actions"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, document_id, text FROM chunks WHERE chunk_id IS NOT NULL), d AS (SELECT document_id, regexp_replace(lower(trim(source)), '[ _]', '-', 'g') AS source FROM documents)
SELECT source, count(*) AS n_chunks, count(DISTINCT document_id) AS n_docs FROM c JOIN d USING (document_id) GROUP BY source""")
def chunks_by_source(t: Tables) -> DataFrame:
    """Chunks and documents of each source."""
    c = t.chunks.where("chunk_id is not null").select("chunk_id", "document_id", "text").distinct()
    d = t.documents.select("document_id", source_key(F.col("source")).alias("source"))
    return c.join(d, "document_id").groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_docs"))
