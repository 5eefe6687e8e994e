"""Queries over search, fusion, reranking and context.

The query set is every document whose id is divisible by 50, asked by its title's keywords against all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.keys import source_key
from corpusflow.operators import context as C
from corpusflow.operators import ranking as R
from corpusflow.operators import rerank as K
from corpusflow.operators import search as S
from corpusflow.plans.registry import Tables, query
from corpusflow.session import broadcast_if_small, checkpointed
from corpusflow.plans.text_queries import STRIP, TOKENS, sql_list

K_TOP = 10
NOW = "2025-11-01 00:00:00"
TRUST = {"security-handbook": 1.5, "legal-archive": 1.3, "help-center": 1.1, "press-desk": 0.8}


def texts(t: Tables) -> DataFrame:
    """(id, text, source, ingested_at) of all documents."""
    return t.wide("documents", "doc_id", "text", "source", "ingested_at", "lang", "format").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), source_key(F.col("source")).alias("source"), "ingested_at", "lang", "format")


def asked(t: Tables) -> DataFrame:
    """(query_id, query, terms) of the query set."""
    title = F.coalesce(X.derive_title(F.col("text")), F.lit(""))
    return t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), title.alias("query"), X.keywords(title).alias("terms"))


def sparse_hits(t: Tables, k: int = K_TOP) -> DataFrame:
    return S.search_texts(asked(t), texts(t), k)


def dense_hits(t: Tables, k: int = K_TOP) -> DataFrame:
    vectors = S.hashed_vectors(texts(t))
    asking = S.hashed_vectors(asked(t).select(F.col("query_id").alias("id"), F.array_join("terms", " ").alias("text")))
    found = S.cosine_top_k(asking, vectors, k)
    return S.ranked(found.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), "score"))


def with_texts(t: Tables, hits: DataFrame) -> DataFrame:
    """Hits with their document's columns, once: the few hits come to the documents, and what they meet is kept."""
    return checkpointed(texts(t).join(broadcast_if_small(hits), "id"))


TITLE = f"coalesce(left(trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda l: {STRIP.format('l')}), lambda l: l <> '')[1], '^#+', '')), 200), '')"
ASKED = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(lower(trim(source)), '[ _]', '-', 'g') AS source, ingested_at FROM documents),
asked AS (SELECT doc_id AS query_id, {TITLE} AS query FROM docs WHERE doc_id % 50 = 0),
asked_terms AS (SELECT query_id, query, list_filter({TOKENS.format('query')}, lambda x: x NOT IN {sql_list(X.STOPWORDS)}) AS terms FROM asked)"""
BM25 = f"""
tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM docs),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM asked_terms) GROUP BY ALL),
bm AS (SELECT query_id, tf.doc_id AS id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qtf JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
bm_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0),
bm_hits AS (SELECT * FROM bm_all WHERE rank <= {K_TOP})"""


def _hashed(name: str, source: str, key: str) -> str:
    return f"""
{name}_t AS (SELECT {key} AS id, unnest({TOKENS.format('text')}) AS term FROM {source}),
{name}_s AS (SELECT id, ('0x' || substr(md5(term), 1, 2))::INT AS idx, sum(CASE WHEN ('0x' || substr(md5(term), 9, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_s GROUP BY id),
{name} AS (SELECT s.id, idx, v / norm AS value FROM {name}_s s JOIN {name}_n n ON s.id = n.id WHERE norm > 0)"""


DENSE = f"""
asked_text AS (SELECT query_id, array_to_string(terms, ' ') AS text FROM asked_terms),{_hashed('dv', 'docs', 'doc_id')},{_hashed('qv', 'asked_text', 'query_id')},
ds AS (SELECT qs.id AS query_id, di.id AS id FROM (SELECT DISTINCT id FROM qv) qs, (SELECT DISTINCT id FROM dv) di),
dots AS (SELECT qv.id AS query_id, dv.id AS id, sum(qv.value * dv.value) AS s FROM qv JOIN dv USING (idx) GROUP BY ALL),
dense AS (SELECT query_id, id, round(coalesce(s, 0), 6) + 0.0 AS score FROM ds LEFT JOIN dots USING (query_id, id))"""
DENSE_TEXT_ORDER = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR)"


@query(f"WITH {ASKED},{BM25} SELECT query_id, id, score, rank::INT AS rank FROM bm_hits")
def bm25_search(t: Tables) -> DataFrame:
    """The ten best documents for each query by BM25."""
    return sparse_hits(t)


@query(f"WITH {_hashed('d', 'documents', 'doc_id')} SELECT id, count(*) AS n_dims, round(sum(value), 6) AS total, round(max(value), 6) AS largest FROM d GROUP BY id")
def hashed_embeddings(t: Tables) -> DataFrame:
    """Shape of each document's hashed vector."""
    return S.hashed_terms(texts(t)).groupBy("id").agg(F.count("*").alias("n_dims"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("value"), 6).alias("largest"))


@query(r"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents),
g AS (SELECT id, unnest(CASE WHEN length(w) < 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)) END) AS g FROM w),
h AS (SELECT g, ('0x' || right(s, 2))::INT % 128 AS a, list_sum(list_transform(string_split(s, ''), lambda c: ('0x' || c)::INT))::INT % 3 AS b FROM (SELECT g, sha256(g) AS s FROM (SELECT DISTINCT g FROM g))),
p AS (SELECT g, a + 128 * ((((b - a) % 3 + 3) * 2) % 3) AS idx FROM h), v AS (SELECT id, idx, count(*)::DOUBLE AS v FROM g JOIN p USING (g) GROUP BY ALL)
SELECT id, count(*) AS n_dims, round(max(v) / sqrt(sum(v * v)), 6) AS largest FROM v GROUP BY id""")
def trigram_embeddings(t: Tables) -> DataFrame:
    """Shape of each document's trigram vector."""
    return S.trigram_terms(texts(t)).groupBy("id").agg(F.count("*").alias("n_dims"), F.round(F.max("value"), 6).alias("largest"))


@query(f"WITH {ASKED},{DENSE}, top AS (SELECT *, {DENSE_TEXT_ORDER} AS n FROM dense) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM top WHERE n <= {K_TOP}")
def dense_search(t: Tables) -> DataFrame:
    """The ten most similar documents for each query by hashed vectors."""
    return dense_hits(t)


HYBRID = f"""
top30 AS (SELECT *, {DENSE_TEXT_ORDER} AS n FROM dense),
da AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS dr FROM top30 WHERE n <= {3 * K_TOP}),
sa AS (SELECT query_id, id, rank AS sr FROM bm_all WHERE rank <= {3 * K_TOP}),
fused AS (SELECT query_id, id, round(coalesce(0.6 / (60 + dr), 0) + coalesce(0.4 / (60 + sr), 0), 6) AS score,
          CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 'both' WHEN dr IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS found_by FROM da FULL JOIN sa USING (query_id, id)),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fused QUALIFY rank <= {K_TOP})"""


def hybrid_hits(t: Tables, weights: tuple[float, float] = X.PROFILES["balanced"]) -> DataFrame:
    return S.weighted_rrf(dense_hits(t, 3 * K_TOP), sparse_hits(t, 3 * K_TOP), weights, top=K_TOP)


@query(f"WITH {ASKED},{BM25},{DENSE},{HYBRID} SELECT query_id, id, score, found_by, rank FROM hybrid")
def hybrid_search(t: Tables) -> DataFrame:
    """The ten best documents by weighted fusion of dense and sparse search, and which of them found each."""
    return hybrid_hits(t)


def _overlap_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, id, '{p}' AS branch FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce({a} / (60 + dr), 0) + coalesce({b} / (60 + sr), 0), 6) DESC, id) AS n FROM da FULL JOIN sa USING (query_id, id)) WHERE n <= {K_TOP}" for p, (a, b) in X.PROFILES.items())
    return f"WITH {ASKED},{BM25},{DENSE},{HYBRID}, l AS ({parts}) SELECT query_id, id, string_agg(branch, ',' ORDER BY branch) AS branches FROM l GROUP BY ALL"


@query(_overlap_sql())
def profile_overlap(t: Tables) -> DataFrame:
    """Under which weight profiles each document is among a query's ten best."""
    dense, sparse = checkpointed(dense_hits(t, 3 * K_TOP)), checkpointed(sparse_hits(t, 3 * K_TOP))
    lists = [S.weighted_rrf(dense, sparse, X.PROFILES[p], top=K_TOP).select("query_id", "id", F.lit(p).alias("branch")) for p in X.PROFILES]
    return R.overlap(reduce(DataFrame.unionByName, lists))


NAMES = ("Orvane", "Talvex", "audit", "renewal")


@query(f"""
WITH m AS (SELECT doc_id AS id, list_filter([{', '.join(f"'{n}'" for n in NAMES)}], lambda e: contains(lower(text), lower(e))) AS matched FROM documents WHERE text IS NOT NULL),
r AS (SELECT id, round(len(matched) / 4.0, 6)::DOUBLE AS score, array_to_string(matched, ',') AS matched, row_number() OVER (ORDER BY round(len(matched) / 4.0, 6) DESC, id)::INT AS rank FROM m WHERE len(matched) > 0)
SELECT id, score, matched, rank FROM r WHERE rank <= 20""")
def entity_hits(t: Tables) -> DataFrame:
    """The twenty documents that name most of four entities."""
    asking = t.spark.createDataFrame([(1, list(NAMES))], "query_id int, entities array<string>")
    return S.entity_search(asking, texts(t), 20).select("id", "score", F.array_join("matched", ",").alias("matched"), "rank")


@query("""
WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR)::INT AS rank FROM p)
SELECT query_id, id, score, rank FROM r WHERE rank <= 10""")
def cosine_top_10(t: Tables) -> DataFrame:
    """The ten most similar vectors for every fiftieth."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = S.cosine_top_k(vectors.where("id % 50 = 0"), vectors, 10)
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), "score", "rank")


@query("""
WITH p AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR)::INT AS rank FROM p)
SELECT query_id, id, score, rank FROM r WHERE rank <= 5""")
def cosine_top_5_in_label(t: Tables) -> DataFrame:
    """The five most similar vectors of the same label for every fiftieth: the filter comes before scoring."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = S.cosine_top_k(vectors.where("id % 50 = 0"), vectors, 5, ["label"])
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), "score", "rank")


def branches(t: Tables) -> DataFrame:
    """(query_id, branch, pos, id, score): dense and sparse hits as two branches."""
    part = lambda d, n: d.select("query_id", F.lit(n).alias("branch"), F.col("rank").alias("pos"), "id", "score")
    return part(dense_hits(t), "a").unionByName(part(sparse_hits(t), "b"))


BRANCHES = f"""
d10 AS (SELECT *, {DENSE_TEXT_ORDER} AS n FROM dense),
branches AS (SELECT query_id, 'a' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, id, score FROM d10 WHERE n <= {K_TOP}
             UNION ALL SELECT query_id, 'b', rank, id, score FROM bm_hits)"""
ALL = f"WITH {ASKED},{BM25},{DENSE},{BRANCHES}"


@query(ALL + " SELECT query_id, branch, pos::INT AS pos, id, score, row_number() OVER (PARTITION BY query_id ORDER BY branch, pos)::INT AS \"order\" FROM branches")
def merge_concat(t: Tables) -> DataFrame:
    """Both branches' hits one after the other."""
    return R.concatenate(branches(t))


@query(ALL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY branch, pos) AS n FROM branches) SELECT query_id, branch, pos::INT AS pos, id, score FROM r WHERE n = 1")
def merge_dedup(t: Tables) -> DataFrame:
    """The first of equal hits."""
    return R.deduplicate(branches(t))


@query(ALL + """, c AS (SELECT query_id, id, sum(1.0 / (60 + pos)) AS s, min(branch || lpad(pos::VARCHAR, 4, '0')) AS f FROM branches GROUP BY ALL)
SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, f, id)::INT AS rank FROM c""")
def merge_rrf(t: Tables) -> DataFrame:
    """Unweighted reciprocal rank fusion of both branches."""
    return R.rrf(branches(t)).withColumn("score", F.round("score", 6))


@query(ALL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, branch, pos)::INT AS rank FROM branches)
SELECT query_id, branch, pos::INT AS pos, id, score, rank FROM r WHERE rank <= {K_TOP}""")
def merge_ranking(t: Tables) -> DataFrame:
    """The ten best of both branches by score."""
    return R.ranking(branches(t), K_TOP)


@query(ALL + """, w AS (SELECT query_id, branch, pos, id, score * CASE branch WHEN 'b' THEN 0.05 ELSE 1.0 END AS score FROM branches)
SELECT query_id, branch, pos::INT AS pos, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, branch, pos)::INT AS rank FROM w""")
def merge_weighted(t: Tables) -> DataFrame:
    """Both branches by weighted score."""
    return R.weighted(branches(t), {"b": 0.05}).withColumn("score", F.round("score", 6))


@query(ALL + """, v AS (SELECT query_id, source, count(*) AS votes, min(branch || lpad(pos::VARCHAR, 4, '0')) AS f FROM branches JOIN docs ON docs.doc_id = id GROUP BY ALL),
r AS (SELECT *, votes / sum(votes) OVER (PARTITION BY query_id) AS support, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, f) AS n FROM v)
SELECT query_id, source, votes, round(support, 6) AS support, support >= 0.2 AS agreed FROM r WHERE n = 1""")
def merge_votes(t: Tables) -> DataFrame:
    """The source that most hits of a query come from, and whether a fifth of them agree on it."""
    rows = branches(t).join(texts(t).select("id", "source"), "id")
    return R.voting(rows, "source").select("query_id", "source", "votes", F.round("support", 6).alias("support"), (F.col("support") >= 0.2).alias("agreed"))


@query(ALL + """, x AS (SELECT query_id, id, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches FROM branches GROUP BY ALL) SELECT * FROM x""")
def merge_overlap(t: Tables) -> DataFrame:
    """Which branches found each hit."""
    return R.overlap(branches(t))


@query("""SELECT document_id AS query_id, chunk_id AS id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(chunk_index, 0), chunk_id)::INT AS "order" FROM (SELECT DISTINCT document_id, chunk_id, chunk_index FROM chunks)""")
def narrative_chunks(t: Tables) -> DataFrame:
    """Every document's chunks in reading order."""
    rows = t.chunks.select(F.col("document_id").alias("query_id"), F.col("chunk_id").alias("id"), "chunk_index").distinct()
    return R.narrative_order(rows).select("query_id", "id", "order")


def answer_rows(t: Tables) -> DataFrame:
    """(query_id, branch, pos, answer): the answer in the log and those in the feedback of a query."""
    logged = t.query_logs.select(F.col("id").alias("query_id"), F.lit("log").alias("branch"), F.lit(1).alias("pos"), "answer").distinct()
    rated = t.feedback_records.select("query_id", F.concat(F.lit("feedback "), "id").alias("branch"), F.lit(1).alias("pos"), "answer").distinct()
    return rated.unionByName(logged.join(rated.select("query_id").distinct(), "query_id", "left_semi")).where("answer is not null and query_id is not null")


POINTS = r"""
WITH r AS (SELECT DISTINCT query_id, 'feedback ' || id AS branch, answer FROM feedback_records WHERE query_id IS NOT NULL AND answer IS NOT NULL),
a AS (SELECT * FROM r UNION ALL SELECT DISTINCT id, 'log', answer FROM query_logs WHERE answer IS NOT NULL AND id IN (SELECT DISTINCT query_id FROM feedback_records)),
s AS (SELECT query_id, branch, unnest(regexp_split_to_array(answer, '[.!?]+')) AS s FROM a),
p AS (SELECT DISTINCT query_id, branch, regexp_replace(lower(""" + STRIP.format("s") + r"""), '[.!?]+$', '') AS point FROM s WHERE length(""" + STRIP.format("s") + """) > 5),
n AS (SELECT query_id, count(DISTINCT branch) AS n FROM a WHERE trim(answer) <> '' GROUP BY query_id)"""


@query(POINTS + " SELECT query_id, point FROM p JOIN n USING (query_id) GROUP BY query_id, point, n HAVING count(*) = n AND n > 1")
def answer_common_ground(t: Tables) -> DataFrame:
    """What all answers to a query say."""
    return R.common_ground(answer_rows(t))


@query(POINTS + ", u AS (SELECT query_id, min(branch) AS branch, point FROM p GROUP BY query_id, point HAVING count(*) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY point) AS i FROM u) SELECT query_id, branch, point FROM k WHERE i <= 3")
def answer_differences(t: Tables) -> DataFrame:
    """What only one of the answers to a query says."""
    return R.differences(answer_rows(t))


ANSWERS = r"""
r AS (SELECT DISTINCT query_id, 'feedback ' || id AS branch, answer FROM feedback_records WHERE query_id IS NOT NULL AND answer IS NOT NULL),
a AS (SELECT * FROM r UNION ALL SELECT DISTINCT id, 'log', answer FROM query_logs WHERE answer IS NOT NULL AND id IN (SELECT DISTINCT query_id FROM feedback_records))"""


def _merged_sql(source: str, most: str) -> str:
    return rf"""s AS (SELECT query_id, branch, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT query_id, branch, string_split(regexp_replace({STRIP.format('answer')}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM {source})),
f AS (SELECT * FROM s WHERE trim(s) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(lower({STRIP.format('s')}), '[.!?]+$', '') ORDER BY branch, i) = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY branch, i) AS n FROM f),
merged AS (SELECT query_id, string_agg({STRIP.format('s')}, ' ' ORDER BY branch, i) AS answer FROM l {most} GROUP BY query_id)"""


@query(f"WITH {ANSWERS},{_merged_sql('a', 'WHERE n <= 12')} SELECT query_id, answer FROM merged")
def answer_merged(t: Tables) -> DataFrame:
    """One answer of the different sentences of all answers to a query."""
    return R.merged_answer(answer_rows(t))


@query(f"""WITH {ANSWERS}, told AS (SELECT * FROM a WHERE trim(answer) <> '' AND NOT regexp_matches(lower(answer), 'don.t know|no information|not found|unavailable')),{_merged_sql('told', '')}
SELECT q.query_id, coalesce(merged.answer, 'I could not find enough information to answer this question.') AS answer, coalesce(n, 0) AS source_count FROM (SELECT DISTINCT query_id FROM a) q LEFT JOIN merged USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM told GROUP BY query_id) c USING (query_id)""")
def answer_synthesized(t: Tables) -> DataFrame:
    """One answer of those that say something."""
    return R.synthesized(answer_rows(t))


CROSS = f"""
qx AS (SELECT query_id, query AS text FROM asked),{_hashed('qf', 'qx', 'query_id')},
sem AS (SELECT b.query_id, b.id, sum(qf.value * dv.value) AS s FROM bm_hits b JOIN qf ON qf.id = b.query_id JOIN dv ON dv.id = b.id AND dv.idx = qf.idx GROUP BY ALL),
cross_hits AS (SELECT b.query_id, b.id, round(0.6 * coalesce(s, 0) + 0.4 * len(list_intersect(list_distinct({TOKENS.format('a.query')}), list_distinct({TOKENS.format('d.text')}))) / len(list_distinct({TOKENS.format('a.query')}))::DOUBLE, 6) AS score, b.rank AS old_rank, d.source, d.ingested_at
          FROM bm_hits b JOIN asked a ON a.query_id = b.query_id JOIN docs d ON d.doc_id = b.id LEFT JOIN sem ON sem.query_id = b.query_id AND sem.id = b.id),
crossed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM cross_hits)"""
AGE = f"greatest(0, epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(ingested_at)) / 86400000000.0"


@query(f"WITH {ASKED},{BM25},{DENSE},{CROSS} SELECT query_id, id, score, rank FROM crossed")
def rerank_cross_encoder(t: Tables) -> DataFrame:
    """BM25's hits ranked by meaning and words together."""
    return K.cross_encoder(with_texts(t, sparse_hits(t)), asked(t)).select("query_id", "id", "score", "rank")


@query(f"""WITH {ASKED},{BM25}, r AS (SELECT query_id, b.id, round(score * pow(0.5, {AGE} / 30), 6) AS score FROM bm_hits b JOIN docs d ON d.doc_id = b.id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r""")
def rerank_recency(t: Tables) -> DataFrame:
    """BM25's hits, older ones lowered."""
    return K.recency(with_texts(t, sparse_hits(t)), "ingested_at", F.lit(NOW).cast("timestamp")).select("query_id", "id", "score", "rank")


TRUST_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TRUST.items()) + " ELSE 1.0 END::DOUBLE"


@query(f"""WITH {ASKED},{BM25}, r AS (SELECT query_id, b.id, round(score * {TRUST_SQL}, 6) AS score FROM bm_hits b JOIN docs d ON d.doc_id = b.id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r""")
def rerank_authority(t: Tables) -> DataFrame:
    """BM25's hits weighed by source."""
    return K.authority(with_texts(t, sparse_hits(t)), "source", TRUST).select("query_id", "id", "score", "rank")


@query(f"""WITH {ASKED},{BM25},{DENSE},{CROSS}, r AS (SELECT query_id, id, round(0.6 * score + 0.3 * pow(0.5, {AGE} / 30) + 0.1 * {TRUST_SQL}, 6) AS score FROM crossed)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r""")
def rerank_multi_factor(t: Tables) -> DataFrame:
    """BM25's hits by relevance, age and source together."""
    hits = with_texts(t, sparse_hits(t))
    return K.multi_factor(hits, asked(t), "ingested_at", F.lit(NOW).cast("timestamp"), "source", {"relevance": 0.6, "recency": 0.3, "authority": 0.1}, TRUST).select("query_id", "id", "score", "rank")


@query()
def rerank_mmr(t: Tables) -> DataFrame:
    """BM25's hits in an order of likeness to the query and unlikeness to each other."""
    asking = S.hashed_vectors(asked(t).select(F.col("query_id").alias("id"), F.col("query").alias("text")))
    hits = with_texts(t, sparse_hits(t))
    chosen = hits.select("id", "text").dropDuplicates(["id"])
    return K.mmr(hits, S.hashed_vectors(chosen), asking).withColumn("score", F.round("score", 6))


@query(f"WITH {ASKED},{BM25},{DENSE},{CROSS} SELECT query_id, id, old_rank::INT AS old_rank, rank AS new_rank, (old_rank - rank)::INT AS change, CASE WHEN old_rank > rank THEN 'Moved UP ' || (old_rank - rank) || ' positions — more relevant to query' WHEN old_rank < rank THEN 'Moved DOWN ' || (rank - old_rank) || ' positions — less relevant' ELSE 'No change in rank' END AS verdict FROM crossed")
def rerank_changes(t: Tables) -> DataFrame:
    """Positions that BM25's hits win or lose by the cross-encoder."""
    hits = with_texts(t, sparse_hits(t))
    return K.rank_changes(hits, K.cross_encoder(hits, asked(t)))


@query(f"""WITH {ASKED},{BM25},{DENSE},{CROSS},
rec AS (SELECT query_id, b.id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * pow(0.5, {AGE} / 30), 6) DESC, b.id) AS rank FROM bm_hits b JOIN docs d ON d.doc_id = b.id),
aut AS (SELECT query_id, b.id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * {TRUST_SQL}, 6) DESC, b.id) AS rank FROM bm_hits b JOIN docs d ON d.doc_id = b.id)
SELECT query_id, round(avg((c.id = r.id AND c.id = a.id)::INT), 6) AS agreement FROM crossed c JOIN rec r USING (query_id, rank) JOIN aut a USING (query_id, rank) GROUP BY query_id""")
def rerank_agreement(t: Tables) -> DataFrame:
    """Share of positions at which three rerankings agree."""
    hits = with_texts(t, sparse_hits(t))
    return K.agreement([K.cross_encoder(hits, asked(t)), K.recency(hits, "ingested_at", F.lit(NOW).cast("timestamp")), K.authority(hits, "source", TRUST)])


def _about(topic: str) -> str:
    return "(" + " OR ".join(f"contains(low, '{p}')" for p in X.TOPICS[topic]) + ")::INT"


@query(f"""WITH {ASKED},{BM25}, h AS (SELECT b.query_id, b.id, b.score AS original_score, lower(d.text) AS low, d.source, lower(e.format) AS kind, year(d.ingested_at AT TIME ZONE 'UTC') AS y FROM bm_hits b JOIN docs d ON d.doc_id = b.id JOIN documents e ON e.doc_id = b.id),
s AS (SELECT *, round(0.15 * {_about('Finance')} - 0.40 * {_about('Legal')} + 0.2 * greatest(0.0, 1 - (DATE '{NOW[:10]}' - make_date(y, 1, 1)) / 730.0) + CASE WHEN contains(coalesce(source, ''), 'help') THEN 0.10 ELSE 0.0 END + CASE WHEN kind = 'markdown' THEN 0.08 ELSE 0.0 END, 6)::DOUBLE AS boost FROM h)
SELECT query_id, id, original_score, boost, round(original_score + boost, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(original_score + boost, 6) DESC, id)::INT AS rank FROM s""")
def personalized_hits(t: Tables) -> DataFrame:
    """BM25's hits for a reader of finance who avoids legal matters."""
    profile = [F.array(F.lit("Finance")).alias("interests"), F.array(F.lit("Legal")).alias("disinterests"), F.array(F.lit("help")).alias("authority_sources"), F.array(F.lit("markdown")).alias("preferred_types")]
    hits = with_texts(t, sparse_hits(t)).withColumn("date_year", F.year("ingested_at")).withColumn("doc_type", F.col("format"))
    return K.personalize(hits, asked(t).select("query_id", *profile), F.lit(NOW).cast("timestamp")).select("query_id", "id", "original_score", "boost", "score", "rank")


@query(f"""WITH RECURSIVE {ASKED},{BM25}, h AS (SELECT query_id, id, rank, greatest(1, length({STRIP.format('text')}) // 4) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM bm_hits b JOIN docs d ON d.doc_id = b.id WHERE {STRIP.format('text')} <> ''),
f AS (SELECT query_id, id, rank, tokens, i, true AS included, tokens AS total, 1 AS n FROM h WHERE i = 1
      UNION ALL SELECT h.query_id, h.id, h.rank, h.tokens, h.i, f.total + h.tokens <= 1024, f.total + CASE WHEN f.total + h.tokens <= 1024 THEN h.tokens ELSE 0 END, f.n + (f.total + h.tokens <= 1024)::INT
      FROM f JOIN h ON h.query_id = f.query_id AND h.i = f.i + 1)
SELECT query_id, id, rank::INT AS rank, tokens::INT AS tokens, included, CASE WHEN included THEN '[' || n || ']' END AS marker FROM f""")
def context_budget(t: Tables) -> DataFrame:
    """Which of BM25's hits fit a context of 1024 tokens."""
    return C.within_budget(with_texts(t, sparse_hits(t)))


@query(f"""WITH RECURSIVE {ASKED},{BM25}, h AS (SELECT query_id, id, rank, source, {STRIP.format('text')} AS body, greatest(1, length({STRIP.format('text')}) // 4) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM bm_hits b JOIN docs d ON d.doc_id = b.id WHERE {STRIP.format('text')} <> ''),
f AS (SELECT query_id, i, true AS included, tokens AS total, 1 AS n FROM h WHERE i = 1
      UNION ALL SELECT h.query_id, h.i, f.total + h.tokens <= 1024, f.total + CASE WHEN f.total + h.tokens <= 1024 THEN h.tokens ELSE 0 END, f.n + (f.total + h.tokens <= 1024)::INT FROM f JOIN h ON h.query_id = f.query_id AND h.i = f.i + 1),
c AS (SELECT f.query_id, string_agg(CASE WHEN included THEN '[' || n || ']' || coalesce(' (' || source || ')', '') || chr(10) || body END, chr(10) || chr(10) ORDER BY f.i) AS context, sum(CASE WHEN included THEN tokens ELSE 0 END)::BIGINT AS token_estimate, count_if(included)::BIGINT AS n_included, count_if(NOT included)::BIGINT AS n_dropped FROM f JOIN h ON h.query_id = f.query_id AND h.i = f.i GROUP BY f.query_id)
SELECT query_id, token_estimate, n_included, n_dropped, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM c JOIN asked USING (query_id)""")
def context_texts(t: Tables) -> DataFrame:
    """The context and prompt of each query."""
    built = C.build_context(with_texts(t, sparse_hits(t))).join(asked(t).select("query_id", "query"), "query_id")
    return built.select("query_id", "token_estimate", "n_included", "n_dropped", C.build_prompt(F.col("query"), F.col("context"), "qa")["user"].alias("prompt"))


@query(f"""WITH {ASKED},{BM25}, h AS (SELECT b.*, source FROM bm_hits b JOIN docs d ON d.doc_id = b.id),
k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, source) AS first, rank FROM h)
SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY turn, first, rank) - 1)::INT AS "order" FROM k""")
def context_diversity(t: Tables) -> DataFrame:
    """BM25's hits with their sources taking turns."""
    return C.organize(with_texts(t, sparse_hits(t)), "diversity").select("query_id", "id", "order")


@query(f"""WITH {ASKED},{BM25}, h AS (SELECT b.*, source FROM bm_hits b JOIN docs d ON d.doc_id = b.id),
k AS (SELECT query_id, id, score, rank, max(score) OVER (PARTITION BY query_id, source) AS best, min(rank) OVER (PARTITION BY query_id, source) AS first FROM h)
SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, score DESC, rank) - 1)::INT AS "order" FROM k""")
def context_by_source(t: Tables) -> DataFrame:
    """BM25's hits grouped by source, the source of the best hit first."""
    return C.organize(with_texts(t, sparse_hits(t)), "source").select("query_id", "id", "order")


@query(f"""WITH {ASKED},{BM25}, x AS (SELECT b.query_id, b.id, b.rank, d.text, len(list_intersect(list_distinct({TOKENS.format('a.query')}), list_distinct({TOKENS.format('d.text')}))) AS shared FROM bm_hits b JOIN asked a USING (query_id) JOIN docs d ON d.doc_id = b.id),
t AS (SELECT query_id, id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')[1:2] AS ss FROM x WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, rank) = 1)
SELECT a.query_id, t.id, coalesce({STRIP.format("array_to_string(ss, ' ')")}, 'I don''t know based on the provided context.') AS answer FROM asked a LEFT JOIN t USING (query_id)""")
def extractive_answers(t: Tables) -> DataFrame:
    """An answer to each query made of the best hit's first sentences."""
    return C.extractive_answers(with_texts(t, sparse_hits(t)), asked(t))
