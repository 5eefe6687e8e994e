"""Queries that chain operators: merged and routed search, caches, indexing, tenants, insights, logs and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions import values as U
from corpusflow.functions.conditions import classified
from corpusflow.functions.formats import canonical_format
from corpusflow.operators import analytics as A
from corpusflow.operators import chunking as H
from corpusflow.operators import graph as G
from corpusflow.operators import ranking as R
from corpusflow.operators import rerank as K
from corpusflow.operators import search as S
from corpusflow.operators import store as V
from corpusflow.plans.corpus_queries import EDGES, edges
from corpusflow.plans.log_queries import LATEST, PRICE_SQL, USAGE, feedback, latest, usage
from corpusflow.plans.registry import Tables, query
from corpusflow.plans.search_queries import ASKED, BM25, DENSE, DENSE_TEXT_ORDER, K_TOP, _hashed, asked, dense_hits, sparse_hits, texts, with_texts
from corpusflow.plans.text_queries import SYNONYMS, TOKENS, questions, sql_list
from corpusflow.plans.user_queries import asked_sample
from corpusflow.session import broadcast_if_small, checkpointed

# ---- merged and routed search -------------------------------------------------------------------------------------

ENTITY = f"""
ent AS (SELECT query_id, unnest(es) AS e, len(es) AS n FROM (SELECT query_id, regexp_extract_all(query, '\\b[A-Z][a-zA-Z0-9]+\\b') AS es FROM asked)),
held AS (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM docs),
ent_all AS (SELECT query_id, doc_id AS id, round(count(*) / n::DOUBLE, 6) AS score FROM ent JOIN held ON term = lower(e) GROUP BY query_id, doc_id, n),
ent_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ent_all QUALIFY rank <= {K_TOP})"""
THREE = f"""
d10 AS (SELECT *, {DENSE_TEXT_ORDER} AS n FROM dense),
branches AS (SELECT query_id, 'a' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, id, score FROM d10 WHERE n <= {K_TOP}
             UNION ALL SELECT query_id, 'b', rank, id, score FROM bm_hits UNION ALL SELECT query_id, 'c', rank, id, score FROM ent_hits),
merged AS (SELECT query_id, id, sum(1.0 / (60 + pos)) AS s, min(branch || lpad(pos::VARCHAR, 4, '0')) AS f FROM branches GROUP BY ALL),
fused3 AS (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, f, id)::INT AS rank FROM merged QUALIFY rank <= {K_TOP})"""


def three_branches(t: Tables) -> DataFrame:
    """(query_id, branch, pos, id, score) of semantic, keyword and entity search."""
    named = asked(t).select("query_id", X.query_entities(F.col("query"))["capitalized"].alias("entities"))
    part = lambda d, n: d.select("query_id", F.lit(n).alias("branch"), F.col("rank").alias("pos"), "id", "score")
    return checkpointed(part(dense_hits(t), "a").unionByName(part(sparse_hits(t), "b")).unionByName(part(S.entity_word_search(named, texts(t), K_TOP), "c")))


@query(f"WITH {ASKED},{BM25},{DENSE},{ENTITY},{THREE} SELECT query_id, id, score, rank FROM fused3")
def merged_search(t: Tables) -> DataFrame:
    """The ten best documents of semantic, keyword and entity search together."""
    return R.rrf(three_branches(t), 60, K_TOP).withColumn("score", F.round("score", 6))


ROUTE = f"""
route AS (SELECT query_id, CASE WHEN regexp_matches(query, '"[^"]+"') THEN 'keyword' WHEN q = '' THEN 'hybrid' WHEN ends_with(q, '?') OR w IN {sql_list(X.QUESTION_WORDS)} THEN 'semantic' WHEN w IN {sql_list(X.COMMAND_VERBS)} THEN 'keyword' ELSE 'hybrid' END AS strategy
          FROM (SELECT query_id, query, lower(trim(regexp_replace(query, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS q, split_part(lower(trim(regexp_replace(query, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), ' ', 1) AS w FROM asked))"""


@query(f"""WITH {ASKED},{BM25},{DENSE},{ENTITY},{THREE},{ROUTE}
SELECT query_id, strategy, CASE strategy WHEN 'hybrid' THEN 0.65 ELSE 0.8 END::DOUBLE AS confidence, id, rank FROM route JOIN fused3 USING (query_id) WHERE strategy = 'hybrid'
UNION ALL SELECT query_id, strategy, CASE WHEN regexp_matches(query, '"[^"]+"') THEN 0.95 ELSE 0.8 END, id, pos::INT FROM route JOIN asked USING (query_id) JOIN branches USING (query_id) WHERE branch = CASE strategy WHEN 'semantic' THEN 'a' WHEN 'keyword' THEN 'b' END""")
def routed_search(t: Tables) -> DataFrame:
    """Each query's hits by the search that its wording asks for: quoted phrases and commands by words, questions by meaning, others by all."""
    said = asked(t).select("query_id", "query", X.detect_intent(F.col("query")).alias("intent"))
    rules = [({"op": "regex", "left": "$.query", "right": '"[^"]+"'}, "keyword", 0.95), ({"op": "==", "left": "$.intent", "right": "command"}, "keyword", 0.8), ({"op": "==", "left": "$.intent", "right": "question"}, "semantic", 0.8)]
    chosen = said.select("query_id", classified(rules, {"hybrid": 0.65}, "hybrid").alias("c")).select("query_id", F.col("c.category").alias("strategy"), F.col("c.confidence").alias("confidence"))
    rows = three_branches(t)
    by = F.when(F.col("branch") == "a", "semantic").when(F.col("branch") == "b", "keyword").otherwise("entity")
    single = rows.select("query_id", by.alias("strategy"), "id", F.col("pos").cast("int").alias("rank"))
    hits = single.unionByName(R.rrf(rows, 60, K_TOP).select("query_id", F.lit("hybrid").alias("strategy"), "id", "rank"))
    return chosen.join(hits, ["query_id", "strategy"]).select("query_id", "strategy", "confidence", "id", "rank")


EXPANDED = ASKED.replace("asked_terms AS (", "kept_terms AS (", 1) + f""",
asked_terms AS (SELECT query_id, query, list_concat(terms, flatten(list_transform(terms, lambda w: CASE w {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SYNONYMS.items())} ELSE [] END))) AS terms FROM kept_terms)"""
FULL = f"""
top30 AS (SELECT *, {DENSE_TEXT_ORDER} AS n FROM dense),
da AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS dr FROM top30 WHERE n <= {3 * K_TOP}),
sa AS (SELECT query_id, id, rank AS sr FROM bm_all WHERE rank <= {3 * K_TOP}),
fused AS (SELECT query_id, id, round(coalesce(0.6 / (60 + dr), 0) + coalesce(0.4 / (60 + sr), 0), 6) AS score, CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 'both' WHEN dr IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS found_by FROM da FULL JOIN sa USING (query_id, id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fused QUALIFY rank <= {K_TOP}),
qx AS (SELECT query_id, query AS text FROM asked),{_hashed('qf', 'qx', 'query_id')},
sem AS (SELECT h.query_id, h.id, sum(qf.value * dv.value) AS s FROM hits h JOIN qf ON qf.id = h.query_id JOIN dv ON dv.id = h.id AND dv.idx = qf.idx GROUP BY ALL),
said AS (SELECT h.query_id, h.id, found_by, text, round(0.6 * coalesce(s, 0) + 0.4 * coalesce(len(list_intersect(list_distinct({TOKENS.format('a.query')}), list_distinct({TOKENS.format('d.text')}))) / nullif(len(list_distinct({TOKENS.format('a.query')})), 0)::DOUBLE, 0), 6) AS score, kw
         FROM hits h JOIN (SELECT asked.query_id, asked.query, terms AS kw FROM asked JOIN kept_terms USING (query_id)) a ON a.query_id = h.query_id JOIN docs d ON d.doc_id = h.id LEFT JOIN sem ON sem.query_id = h.query_id AND sem.id = h.id),
cut AS (SELECT query_id, id, kw, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM said)),
best AS (SELECT *, len(list_intersect(list_distinct({TOKENS.format('s')}), list_distinct(kw))) AS n FROM cut QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY n DESC, i) = 1)"""


@query(f"""WITH {EXPANDED},{BM25},{DENSE},{FULL}
SELECT said.query_id, said.id, found_by, score, md5(left(CASE WHEN n > 0 THEN s ELSE text END, 300)) AS highlight, row_number() OVER (PARTITION BY said.query_id ORDER BY score DESC, said.id)::INT AS rank FROM said LEFT JOIN best ON best.query_id = said.query_id AND best.id = said.id""")
def hybrid_search_full(t: Tables) -> DataFrame:
    """Hybrid search with the query expanded, the hits reranked, and the sentence that tells most shown (as its digest)."""
    asking = checkpointed(asked(t))
    kept = F.col("terms")
    wide = asking.withColumn("terms", F.concat(kept, X.expand(kept, SYNONYMS)))
    vectors = S.hashed_vectors(wide.select(F.col("query_id").alias("id"), F.array_join("terms", " ").alias("text")))
    found = S.cosine_top_k(vectors, S.hashed_vectors(texts(t)), 3 * K_TOP)
    dense = S.ranked(found.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), "score"))
    hits = with_texts(t, S.weighted_rrf(dense, S.search_texts(wide, texts(t), 3 * K_TOP), X.PROFILES["balanced"], top=K_TOP))
    ranked = K.cross_encoder(hits, asking).join(asking.select("query_id", "query"), "query_id")
    return ranked.select("query_id", "id", "found_by", "score", F.md5(X.highlight(F.col("text"), F.col("query")).cast("binary")).alias("highlight"), "rank")


# ---- caches ---------------------------------------------------------------------------------------------------------

CUT = "(SELECT date_trunc('day', max(created_at) AT TIME ZONE 'UTC') FROM query_logs)"
CACHED = f"""{LATEST},
told AS (SELECT id, question, created_at AT TIME ZONE 'UTC' >= {CUT} AS new, lower(trim(provider)) AS provider, greatest(1, length(question) // 4) AS tokens_in, greatest(1, length(coalesce(answer, '')) // 4) AS tokens_out FROM latest WHERE question IS NOT NULL),
old AS (SELECT substr(sha1(question), 1, 16) AS id, any_value(question) AS text FROM told WHERE NOT new GROUP BY 1),
fresh AS (SELECT id, question AS text FROM told WHERE new AND substr(md5(id), 1, 2) < '05'),{_hashed('ov', 'old', 'id')},{_hashed('fv', 'fresh', 'id')},
near AS (SELECT f.id AS query_id, o.id AS entry, round(sum(f.value * o.value), 6) AS score FROM fv f JOIN ov o USING (idx) GROUP BY ALL),
sem_hits AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) = 1 AND score >= 0.95)"""


def cache_and_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The cache of all entries before the log's last day, by question, and the query set's entries of that day."""
    day = F.date_trunc("day", F.to_utc_timestamp("created_at", F.current_timezone()))
    rows = latest(t).where("question is not null").withColumn("day", day)
    # One row, joined to all.
    marked = rows.crossJoin(F.broadcast(t.query_logs.agg(F.max(day).alias("last"))))
    old = marked.where("day < last").groupBy(F.substring(F.sha1(F.col("question").cast("binary")), 1, 16).alias("id")).agg(F.min("question").alias("text"))
    return old, asked_sample(marked.where("day >= last"))


@query(f"WITH {CACHED} SELECT query_id, entry, score FROM sem_hits")
def semantic_cache_hits(t: Tables) -> DataFrame:
    """The cached question that answers each new one, if one is near enough in meaning."""
    old, new = cache_and_new(t)
    return S.semantic_cache_lookup(S.hashed_vectors(new.select("id", F.col("question").alias("text"))), S.hashed_vectors(old))


@query(f"""WITH {CACHED}, kind AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM told o WHERE NOT o.new AND o.question = t.question AND o.provider IS NOT DISTINCT FROM t.provider) THEN 'exact' WHEN t.id IN (SELECT query_id FROM sem_hits) THEN 'semantic' ELSE 'none' END AS cache_type,
  CASE t.provider WHEN 'openai' THEN 'gpt-4o' WHEN 'claude' THEN 'claude-3-5-sonnet' WHEN 'gemini' THEN 'gemini-2.5-pro' ELSE 'extractive-stub' END AS model FROM told t JOIN fresh USING (id))
SELECT cache_type, count(*) AS n, round(sum(CASE WHEN cache_type = 'none' THEN (tokens_in * {PRICE_SQL[0]} + tokens_out * {PRICE_SQL[1]} + 50) // 100 / 1000000.0 ELSE 0.0 END::DOUBLE), 6) AS cost FROM kind GROUP BY cache_type""")
def generation_sources(t: Tables) -> DataFrame:
    """Where answers to new questions come from - the exact cache, the semantic one, or a model - and what that costs."""
    old, new = cache_and_new(t)
    provider = F.lower(F.trim("provider"))
    exact = latest(t).where("question is not null").withColumn("day", F.date_trunc("day", F.to_utc_timestamp("created_at", F.current_timezone()))).crossJoin(F.broadcast(t.query_logs.agg(F.max(F.date_trunc("day", F.to_utc_timestamp("created_at", F.current_timezone()))).alias("last"))))
    known = exact.where("day < last").select(F.col("question").alias("q"), provider.alias("p")).distinct()
    new = checkpointed(new.withColumn("provider", provider).select("id", "question", "answer", "provider"))
    near = S.semantic_cache_lookup(S.hashed_vectors(new.select("id", F.col("question").alias("text"))), S.hashed_vectors(old)).select(F.col("query_id").alias("id"), F.lit(True).alias("near"))
    hits = new.join(known.withColumn("same", F.lit(True)), (F.col("question") == F.col("q")) & F.col("provider").eqNullSafe(F.col("p")), "left").join(near, "id", "left")
    kind = F.when(F.col("same"), "exact").when(F.col("near"), "semantic").otherwise("none")
    model = F.when(F.col("provider") == "openai", "gpt-4o").when(F.col("provider") == "claude", "claude-3-5-sonnet").when(F.col("provider") == "gemini", "gemini-2.5-pro").otherwise("extractive-stub")
    size = lambda c: F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4))
    cost = F.when(kind == "none", A.price(model, size("question"), size("answer"))).otherwise(0.0)
    return hits.groupBy(kind.alias("cache_type")).agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))


@query(f"WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),{_hashed('d', 't', 'doc_id')} SELECT id, sha1(any_value(text)) AS key, round(sum(value), 6) AS total FROM d JOIN t ON t.doc_id = d.id GROUP BY id")
def embeddings_once(t: Tables) -> DataFrame:
    """Every document's embedding, each different text being embedded once."""
    rows = S.embedded_once(t.wide("documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", "key", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


CHUNK_ROWS = "c AS (SELECT chunk_id, document_id, chunk_index, text, metadata FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY document_id, chunk_index, text, metadata) = 1)"


@query(f"""WITH {CHUNK_ROWS}, k AS (SELECT * FROM c WHERE chunk_id IS NOT NULL),{_hashed('v', 'k', 'chunk_id')}, n AS (SELECT DISTINCT id FROM v)
SELECT chunk_id AS id, 'docs' AS namespace, 1.0::DOUBLE AS norm, document_id, chunk_index::VARCHAR AS chunk_index, json_extract_string(metadata, '$.chunk_position') AS chunk_position FROM k JOIN n ON n.id = k.chunk_id""")
def chunk_upserts(t: Tables) -> DataFrame:
    """The records that embedding and putting in the chunks makes, their metadata brought up a level and without the text."""
    first = t.chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("document_id", "chunk_index", "text", "metadata")).alias("r")).select("chunk_id", "r.*")
    vectors = S.hashed_vectors(first.select("chunk_id", "text"), "chunk_id")
    items = first.join(vectors, "chunk_id").withColumn("metadata", F.from_json("metadata", "map<string,string>")).withColumn("pos", F.lit(0))
    put = V.chunk_records(items, "docs")
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6)
    own = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return put.where(~F.array_contains(F.map_keys("metadata"), "text")).select("id", "namespace", norm.alias("norm"), own("document_id"), own("chunk_index"), own("chunk_position"))


# ---- indexing, graphs, tenants, insights, logs ------------------------------------------------------------------------


@query(r"""WITH q AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, CASE WHEN text = '' THEN 1.0 ELSE length(regexp_replace(text, '[\p{L}\p{Nd} \n\t.,;:!?\-''"()\[\]{}/@#%&*+=_<>|\\~`^]', '', 'g')) / length(text)::DOUBLE END AS noise FROM q),
m AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) = 0 THEN 0.0 ELSE length(array_to_string(ws, '')) / len(ws)::DOUBLE END AS mean FROM w),
s AS (SELECT doc_id, n, round(greatest(0.0, 1 - (CASE WHEN n < 5 THEN 0.5 WHEN n < 20 THEN 0.2 ELSE 0.0 END + CASE WHEN noise > 0.4 THEN 0.4 WHEN noise > 0.2 THEN 0.15 ELSE 0.0 END
   + CASE WHEN mean < 2 AND n > 5 THEN 0.15 WHEN mean > 15 AND n > 5 THEN 0.1 ELSE 0.0 END + CASE WHEN lang IS NULL AND n >= 5 THEN 0.1 ELSE 0.0 END)), 3) AS score FROM m)
SELECT doc_id AS id, CASE WHEN n = 0 OR score < 0.3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n = 0 OR score < 0.3 THEN 'error' ELSE 'done' END AS step, CASE WHEN n = 0 THEN 10 WHEN score < 0.3 THEN 25 ELSE 100 END AS progress,
  CASE WHEN n = 0 THEN 'Text is empty' WHEN score < 0.3 THEN 'Quality too low (score ' || printf('%.2f', score) || ')' END AS error, n > 0 AND score >= 0.3 AS has_chunks FROM s""")
def index_tasks(t: Tables) -> DataFrame:
    """How indexing each document ends, at which step, and whether chunks come of it."""
    docs = t.wide("documents", "doc_id", "text", "lang").select(F.col("doc_id").alias("id"), "text", "lang")
    cut = H.chunk_documents(docs, "recursive", 512, unit="tokens").groupBy("id").agg(F.count("*").alias("n"))
    rows = docs.join(cut, "id", "left")
    return A.index_tasks(rows, X.assess_quality(F.col("text"), F.col("lang")), F.coalesce("n", F.lit(0))).withColumn("has_chunks", F.col("chunks") > 0).drop("chunks")


@query("""WITH s AS (SELECT 'nation:' || n_name AS entity_id, n_name AS name, n_nationkey AS doc FROM nation UNION ALL SELECT 'nation:' || n_name, lower(n_name), n_nationkey + 100 FROM nation UNION ALL SELECT 'nation:' || n_name, n_name, c_custkey + 1000 FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT entity_id, arg_min(name, doc) AS name, any_value(lower(name)) AS aliases, count(*) AS n_docs, min(doc)::BIGINT AS first_doc, max(doc)::BIGINT AS last_doc FROM s GROUP BY entity_id""")
def graph_merged_entities(t: Tables) -> DataFrame:
    """Nations added again and again in two spellings: the first name, the aliases in order, and in how many documents."""
    nation = t.nation.select(F.concat(F.lit("nation:"), "n_name").alias("entity_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"))
    low = nation.select("entity_id", F.lower("name").alias("name"), (F.col("k") + 100).alias("doc_id"))
    of = t.customer.select((F.col("c_custkey") + 1000).cast("long").alias("doc_id"), F.col("c_nationkey").cast("long").alias("k")).join(F.broadcast(nation), "k").select("entity_id", "name", "doc_id")
    found = nation.select("entity_id", "name", F.col("k").alias("doc_id")).unionByName(low).unionByName(of).withColumn("type", F.lit("NATION"))
    return G.merged_entities(found).select("entity_id", "name", F.array_join("aliases", ",").alias("aliases"), "n_docs", "first_doc", "last_doc")


GONE = "gone AS (SELECT DISTINCT org_slug FROM members WHERE org_slug IS NOT NULL AND org_slug < 'n')"


@query(f"""WITH {GONE}, left_ AS (SELECT DISTINCT user_id, org_slug, team_slug, role FROM members WHERE org_slug IS NULL OR org_slug NOT IN (SELECT org_slug FROM gone))
SELECT org_slug, count(DISTINCT user_id) AS n_members, count(DISTINCT team_slug) AS n_teams, count_if(role IN ('owner', 'admin'))::BIGINT AS n_managers FROM left_ GROUP BY org_slug""")
def tenants_after_removal(t: Tables) -> DataFrame:
    """Organisations with their members and teams after those in the alphabet's first half were deleted, teams and memberships with them."""
    gone = t.members.where("org_slug < 'n'").select("org_slug")
    rest = A.without_organisations(t.members.select("user_id", "org_slug", "team_slug", "role").distinct(), gone)
    return rest.groupBy("org_slug").agg(F.countDistinct("user_id").alias("n_members"), F.countDistinct("team_slug").alias("n_teams"), F.count_if(F.col("role").isin("owner", "admin")).alias("n_managers"))


@query("""WITH fb AS (SELECT DISTINCT id, rating, signals FROM feedback_records WHERE id IS NOT NULL), r AS (SELECT CASE WHEN rating BETWEEN 1 AND 5 THEN rating END AS rating FROM fb),
c AS (SELECT CASE WHEN rating BETWEEN 4 AND 5 THEN 'high' WHEN rating BETWEEN 1 AND 2 THEN 'low' END AS cohort, try_cast(json_extract_string(signals, '$.confidence') AS DOUBLE) AS c, try_cast(json_extract_string(signals, '$.source_count') AS DOUBLE) AS s, json_extract_string(signals, '$.has_numbers') = 'true' AS n FROM fb),
g AS (SELECT cohort, round(avg(c), 3) AS c, round(avg(s), 3) AS s, round(count_if(n) / count(*)::DOUBLE, 6) AS n FROM c WHERE cohort IS NOT NULL GROUP BY cohort),
x AS (SELECT array_to_string(list_filter([CASE WHEN cohort = 'high' AND c > 0.8 THEN 'confident' END, CASE WHEN cohort = 'high' AND s > 1.5 THEN 'many_sources' END, CASE WHEN cohort = 'high' AND n > 0.5 THEN 'numbers' END, CASE WHEN cohort = 'low' AND c < 0.65 THEN 'raise_confidence' END, CASE WHEN cohort = 'low' AND s < 2 THEN 'require_sources' END], lambda x: x IS NOT NULL), ',') AS rules FROM g)
SELECT count(rating) AS total_feedback, round(avg(rating), 4) AS average_rating, round(count_if(rating >= 4) / greatest(1, count(rating))::DOUBLE * 100, 1) AS high_rated_pct, round(count_if(rating <= 2) / greatest(1, count(rating))::DOUBLE * 100, 1) AS low_rated_pct,
  (SELECT coalesce(string_agg(DISTINCT rules, ',' ORDER BY rules), '') FROM x WHERE rules <> '') AS recommendations FROM r""")
def feedback_insights(t: Tables) -> DataFrame:
    """What the feedback says in one row."""
    return A.insights(feedback(t))


def _comparison_sql() -> str:
    options = " UNION ALL ".join(f"SELECT operation, tokens_in, tokens_out, '{m}' AS model, ((tokens_in * {round(a * 100_000)} + tokens_out * {round(b * 100_000)} + 50) // 100 / 1000000.0)::DOUBLE AS cost, {i} AS i FROM means" for i, (m, (a, b, _)) in enumerate(A.MODELS.items()))
    return f"WITH {USAGE}, means AS (SELECT operation, avg(tokens_in)::INT AS tokens_in, avg(tokens_out)::INT AS tokens_out FROM usage GROUP BY operation), o AS ({options}) SELECT operation, tokens_in, tokens_out, model, cost, row_number() OVER (PARTITION BY operation ORDER BY cost, i)::INT AS place FROM o"


@query(_comparison_sql())
def model_comparison(t: Tables) -> DataFrame:
    """What each model would cost for a mean call of each operation, the cheapest first."""
    mean = lambda c: F.bround(F.avg(c)).cast("int").alias(c)
    return A.model_comparison(usage(t).groupBy("operation").agg(mean("tokens_in"), mean("tokens_out")))


@query(f"""WITH {LATEST} SELECT id, user_id, rating, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS seen_at FROM latest WHERE user_id = 'svc-digest' AND rating BETWEEN 1 AND 3 AND confidence >= 0.2 ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50""")
def audit_entries(t: Tables) -> DataFrame:
    """The fifty latest badly rated entries of one user."""
    rows = A.filtered_log(latest(t), "created_at", 50, {"user_id": "svc-digest"}, {"rating": 1, "confidence": 0.2}, {"rating": 3})
    return rows.select("id", "user_id", "rating", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


@query(f"""WITH {USAGE}, m AS (SELECT DISTINCT user_id, org_slug, team_slug FROM members)
SELECT org_slug, team_slug, grouping(org_slug, team_slug)::INT AS level, count(*) AS n_queries, sum(tokens_in + tokens_out)::BIGINT AS tokens, round(sum(cost), 6) AS cost, count_if(cached)::BIGINT AS n_cached, round(count_if(cached) / count(*)::DOUBLE, 4) AS hit_rate FROM usage JOIN m USING (user_id) GROUP BY ROLLUP (org_slug, team_slug)""")
def tenant_costs(t: Tables) -> DataFrame:
    """Queries, tokens, cost and cache hits of each team, organisation and in all."""
    return A.tenant_costs(usage(t), t.members)


KEYS = "keys AS (SELECT user_id || '/' || org_slug AS key_id, sha256(user_id || ':' || org_slug) AS key_hash, bool_or(role = 'viewer') AS revoked, max(joined_at) + INTERVAL 8 YEAR AS expires_at FROM members WHERE user_id IS NOT NULL AND org_slug IS NOT NULL GROUP BY user_id, org_slug)"


@query(f"""WITH {KEYS}, p AS (SELECT u.user_id || ':' || o.org_slug AS key FROM (SELECT DISTINCT user_id FROM query_logs WHERE user_id IS NOT NULL) u, (SELECT DISTINCT org_slug FROM members WHERE org_slug IS NOT NULL) o)
SELECT key, key_id, key_id IS NOT NULL AND NOT coalesce(revoked, false) AND coalesce(expires_at >= TIMESTAMPTZ '2025-11-01 00:00:00+00', true) AS valid FROM p LEFT JOIN keys ON key_hash = sha256(key)""")
def verified_api_keys(t: Tables) -> DataFrame:
    """Which of the keys that users present to each organisation are valid."""
    orgs = t.members.where("org_slug is not null").select("org_slug").distinct()
    users = t.query_logs.where("user_id is not null").select("user_id").distinct()
    # Organisations are a handful beside users.
    presented = users.join(broadcast_if_small(orgs), how="cross").select(F.concat("user_id", F.lit(":"), "org_slug").alias("key"))
    rows = t.members.where("user_id is not null and org_slug is not null").groupBy("user_id", "org_slug").agg(F.bool_or(F.col("role") == "viewer").alias("revoked"), (F.max("joined_at") + F.expr("interval 8 years")).alias("expires_at"))
    keys = rows.select(F.concat("user_id", F.lit("/"), "org_slug").alias("key_id"), F.sha2(F.concat("user_id", F.lit(":"), "org_slug").cast("binary"), 256).alias("key_hash"), "revoked", "expires_at")
    return A.verified_keys(presented, keys, F.lit("2025-11-01 00:00:00").cast("timestamp"))


@query("""WITH e AS (SELECT DISTINCT id, trace_id, lower(trim(provider)) AS provider, created_at, CASE WHEN duration_ms > 0 AND NOT isnan(duration_ms) AND NOT isinf(duration_ms) THEN duration_ms END AS d, answer FROM query_logs WHERE id IS NOT NULL AND trace_id IS NOT NULL)
SELECT trace_id, min_by(id, strftime(created_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f') || id) AS root, count(*) AS n_spans, round(sum(d), 3) AS duration_ms, bool_or(answer IS NULL) AS failed FROM e GROUP BY trace_id""")
def log_traces(t: Tables) -> DataFrame:
    """The traces of the log: the first entry, how many there are, and whether one has no answer."""
    usable = F.when((F.col("duration_ms") > 0) & ~F.isnan("duration_ms") & (F.col("duration_ms") < float("inf")), F.col("duration_ms"))
    rows = t.query_logs.where("id is not null and trace_id is not null").select("trace_id", F.col("id").alias("name"), F.col("created_at").alias("start"), usable.alias("duration_ms"), F.col("answer").isNull().alias("failed"), "provider", "answer")
    return A.traces(rows.withColumn("provider", F.lower(F.trim("provider"))).distinct())


@query(f"""WITH {LATEST}, k AS (SELECT coalesce(lower(trim(provider)), 'unknown') AS scenario, CASE WHEN answer IS NULL OR trim(answer) = '' THEN 'no_answer' WHEN confidence < 0.3 THEN 'unsure' WHEN duration_ms > 10000 AND NOT isnan(duration_ms) THEN 'slow' END AS pattern, id FROM latest)
SELECT scenario, pattern, count(*) AS n, min(id) AS example FROM k WHERE pattern IS NOT NULL GROUP BY ALL""")
def log_error_patterns(t: Tables) -> DataFrame:
    """What goes wrong with each provider, how often, and an example."""
    slow = (F.col("duration_ms") > 10_000) & ~F.isnan("duration_ms")
    pattern = F.when(F.col("answer").isNull() | (F.trim("answer") == ""), "no_answer").when(F.col("confidence") < 0.3, "unsure").when(slow, "slow")
    rows = latest(t).select("id", F.coalesce(F.lower(F.trim("provider")), F.lit("unknown")).alias("scenario"), pattern.alias("pattern"))
    return rows.where("pattern is not null").groupBy("scenario", "pattern").agg(F.count("*").alias("n"), F.min("id").alias("example"))


@query(f"""WITH {EDGES}, d AS (SELECT s AS entity_id FROM e UNION ALL SELECT o FROM e), n AS (SELECT entity_id, count(*) AS degree FROM d GROUP BY 1)
SELECT entity_id, degree, row_number() OVER (ORDER BY degree DESC, entity_id)::INT AS place FROM n ORDER BY degree DESC, entity_id LIMIT 5""")
def graph_top_entities(t: Tables) -> DataFrame:
    """The five entities with most edges."""
    top = G.degrees(edges(t)).orderBy(F.col("degree").desc(), "entity_id").limit(5)
    # Five rows.
    return top.select("entity_id", "degree", F.row_number().over(Window.orderBy(F.col("degree").desc(), "entity_id")).alias("place"))


@query(f"""WITH {ASKED},{BM25} SELECT query_id, source, count(*) AS n, string_agg(b.id::VARCHAR, ',' ORDER BY rank) AS ids FROM bm_hits b JOIN docs d ON d.doc_id = b.id GROUP BY query_id, source""")
def sources_of_hits(t: Tables) -> DataFrame:
    """BM25's hits of each query by source, in their order."""
    hits = with_texts(t, sparse_hits(t)).groupBy("query_id", "source").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
    return hits.select("query_id", "source", F.size("h").cast("long").alias("n"), F.array_join(F.transform("h", lambda x: x["id"].cast("string")), ",").alias("ids"))


# ---- chunkers, values ---------------------------------------------------------------------------------------------------

CHUNKERS = ("recursive", "semantic", "sentence", "structure", "code")


@query(f"SELECT doc_id AS id, strategy, md5(regexp_replace(text, '[\\s.\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', '', 'g')) AS digest, true AS fits FROM documents, (SELECT unnest({list(CHUNKERS)}) AS strategy) WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_coverage(t: Tables) -> DataFrame:
    """For each document and way of cutting, the digest of all its chunks' characters, blanks and full stops aside, and whether all chunks keep to the size."""
    docs = t.wide("documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    rows = None
    for name in CHUNKERS:
        cut = H.chunk_documents(docs, name, 400).select("id", F.lit(name).alias("strategy"), "chunk_index", "text")
        rows = cut if rows is None else rows.unionByName(cut)
    bare = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), ""), r"[\s.\x0B\x1C-\x1F\x{85}\p{Z}]+", "")
    return rows.groupBy("id", "strategy").agg(F.md5(bare.cast("binary")).alias("digest"), (F.max(F.length("text")) <= 400).alias("fits"))


@query("""SELECT doc_id, n_chars > 500 AS long_text, coalesce(starts_with(lang, 'en'), false) AS english, round(1 / (1 + exp(-(n_chars - 500) / 100.0)), 6) AS likely, coalesce(n_chars, 0)::DOUBLE AS score,
  CASE WHEN metadata IS NULL THEN NULL ELSE '{' || array_to_string(list_transform(list_sort(json_keys(metadata)), lambda k: '"' || k || '":' || coalesce(to_json(json_extract_string(metadata, '$.' || k))::VARCHAR, 'null')), ',') || '}' END AS canonical,
  CASE WHEN list_contains(coalesce(json_keys(metadata), []), 'title') THEN json_extract_string(metadata, '$.title') ELSE 'none' END AS title, len(list_filter([lang, source, format], lambda x: x IS NOT NULL)) AS n_labels FROM documents""")
def value_operations(t: Tables) -> DataFrame:
    """Checks, a squashed score, the canonical form of the metadata and values merged over defaults, for each document."""
    checked = U.decision(F.col("n_chars"), {"long_text": {"op": ">", "left": "$.n_chars", "right": 500}, "english": {"op": "startswith", "left": "$.lang", "right": "en"}})
    held = F.from_json("metadata", "map<string,string>")
    outputs = U.merged_outputs(F.array_compact(F.array(F.create_map(F.lit("title"), F.lit("none")), held)))
    labels = U.flattened(F.array(F.array_compact(F.array("lang", "source")), F.array_compact(F.array("format"))))
    return t.documents.select(
        "doc_id", checked["long_text"].alias("long_text"), checked["english"].alias("english"), U.sigmoid((F.col("n_chars") - 500) / 100).alias("likely"), U.scored(F.col("text"), F.col("n_chars").cast("double"))["score"].alias("score"),
        U.canonical_json(F.col("metadata")).alias("canonical"), F.element_at(outputs, "title").alias("title"), F.size(labels).cast("long").alias("n_labels"),
    )


@query("SELECT DISTINCT 'text' AS format, 'text,txt' AS extensions FROM documents WHERE lower(ltrim(format, '.')) IN ('txt', 'text') UNION SELECT DISTINCT 'markdown', 'markdown,md' FROM documents WHERE lower(ltrim(format, '.')) IN ('md', 'markdown') UNION SELECT DISTINCT 'html', 'htm,html' FROM documents WHERE lower(ltrim(format, '.')) IN ('htm', 'html') UNION SELECT DISTINCT f, f FROM (SELECT lower(ltrim(format, '.')) AS f FROM documents) WHERE f IN ('json', 'xml', 'pdf', 'docx', 'xlsx', 'pptx')")
def formats_in_use(t: Tables) -> DataFrame:
    """The formats of the documents, with every extension that each has."""
    used = t.documents.select(canonical_format(F.col("format")).alias("format")).distinct()
    return used.join(F.broadcast(U.supported_formats(t.spark)), "format").select("format", F.array_join("extensions", ",").alias("extensions"))
