"""Queries over texts: tokens, cleaning, query understanding, routing and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.formats import FORMATS, canonical_format, detect_format
from corpusflow.functions.keys import language_key, source_key, token_estimate
from corpusflow.plans.registry import Tables, query

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
STRIP = r"regexp_replace({0}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
SYNONYMS = {"refund": ["reimbursement", "money"], "renewal": ["extension"], "invoice": ["bill"], "report": ["summary"]}
QUESTIONS = "SELECT DISTINCT id, question FROM query_logs WHERE id IS NOT NULL"


def questions(t: Tables) -> DataFrame:
    """(id, question) of each entry of the query log, once."""
    return t.query_logs.where("id is not null").select("id", "question").distinct()


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""
SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct,
       length(text) AS n_chars, greatest(1, length(text) // 4) AS token_estimate,
       len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n_words
FROM documents""")
def token_statistics(t: Tables) -> DataFrame:
    """Tokens, different tokens, characters, estimated tokens and words of each document."""
    tokens = X.tokens(F.col("text"))
    return t.wide("documents", "doc_id", "text", "lang").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"), F.length("text").alias("n_chars"), token_estimate(F.col("text")).alias("token_estimate"), F.size(X.words(F.col("text"))).alias("n_words"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS clean_text
FROM documents""")
def clean_texts(t: Tables) -> DataFrame:
    """Each document's text, composed, with its white space cleaned."""
    return t.wide("documents", "doc_id", "text", "lang").select("doc_id", X.clean_text(F.col("text")).alias("clean_text"))


@query(r"""
SELECT doc_id, left(trim(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda l: l <> '')[1], '^#+', '')), 200) AS title
FROM documents""")
def document_titles(t: Tables) -> DataFrame:
    """A title for each document."""
    return t.wide("documents", "doc_id", "text", "lang").select("doc_id", X.derive_title(F.col("text")).alias("title"))


@query(f"""
WITH q AS ({QUESTIONS}), n AS (SELECT id, trim(regexp_replace(question, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM q)
SELECT intent, count(*) AS n_queries FROM (
  SELECT CASE WHEN t = '' THEN 'empty' WHEN t LIKE '%?' OR split_part(lower(t), ' ', 1) IN {sql_list(X.QUESTION_WORDS)} THEN 'question'
              WHEN split_part(lower(t), ' ', 1) IN {sql_list(X.COMMAND_VERBS)} THEN 'command' ELSE 'keyword' END AS intent FROM n WHERE t IS NOT NULL)
GROUP BY intent""")
def query_intents(t: Tables) -> DataFrame:
    """How many logged queries have each intent."""
    return questions(t).where("question is not null").groupBy(X.detect_intent(F.col("question")).alias("intent")).agg(F.count("*").alias("n_queries"))


@query(f"""
SELECT id, len(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z0-9]+'))) AS n_capitalized, len(regexp_extract_all(question, '\\b\\d+(?:\\.\\d+)?\\b')) AS n_numbers,
       array_to_string(regexp_extract_all(question, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'), ' ') AS dates
FROM ({QUESTIONS}) WHERE question IS NOT NULL""")
def query_entity_counts(t: Tables) -> DataFrame:
    """Capitalised words, numbers and dates in each logged query."""
    e = X.query_entities(F.col("question"))
    return questions(t).where("question is not null").select("id", F.size(e["capitalized"]).alias("n_capitalized"), F.size(e["numbers"]).alias("n_numbers"), F.array_join(e["dates"], " ").alias("dates"))


@query(f"""
WITH q AS (SELECT id, list_filter({TOKENS.format('question')}, lambda x: x NOT IN {sql_list(X.STOPWORDS)}) AS kw FROM ({QUESTIONS}) WHERE question IS NOT NULL),
s AS (SELECT unnest(['refund', 'renewal', 'invoice', 'report']) AS w, unnest(['reimbursement money', 'extension', 'bill', 'summary']) AS syn)
SELECT q.id, array_to_string(kw, ' ') AS keywords,
       coalesce((SELECT string_agg(syn, ' ' ORDER BY i) FROM (SELECT unnest(q.kw) AS k, generate_subscripts(q.kw, 1) AS i) u JOIN s ON s.w = u.k), '') AS expansion
FROM q""")
def query_expansion(t: Tables) -> DataFrame:
    """Keywords of each logged query and what synonyms add to them."""
    p = X.process_query(F.col("question"), SYNONYMS)
    return questions(t).where("question is not null").select("id", F.array_join(p["keywords"], " ").alias("keywords"), F.array_join(p["expansion"], " ").alias("expansion"))


def _class_sql() -> str:
    counts = ", ".join(f"len(regexp_extract_all(question, '{p}')) * {w} AS {k}" for k, (w, p) in X.CLASS_SIGNALS.items())
    return f"""
WITH s AS (SELECT id, {counts} FROM ({QUESTIONS}) WHERE question IS NOT NULL),
c AS (SELECT CASE WHEN greatest(technical, conceptual, analytical, factual) = 0 THEN 'general'
  WHEN technical = greatest(technical, conceptual, analytical, factual) THEN 'technical' WHEN conceptual = greatest(technical, conceptual, analytical, factual) THEN 'conceptual'
  WHEN analytical = greatest(technical, conceptual, analytical, factual) THEN 'analytical' ELSE 'factual' END AS query_class FROM s)
SELECT query_class, CASE query_class WHEN 'technical' THEN 'technical' WHEN 'conceptual' THEN 'conceptual' WHEN 'analytical' THEN 'semantic' ELSE 'balanced' END AS profile,
  CASE query_class WHEN 'technical' THEN 0.3 WHEN 'conceptual' THEN 0.8 WHEN 'analytical' THEN 0.8 ELSE 0.6 END::DOUBLE AS dense_weight, count(*) AS n_queries
FROM c GROUP BY ALL"""


@query(_class_sql())
def query_classes(t: Tables) -> DataFrame:
    """Logged queries by class, with the weight profile that each class gets."""
    profile = X.profile_of_class(F.col("query_class"))
    counts = questions(t).where("question is not null").groupBy(X.classify_query(F.col("question")).alias("query_class")).agg(F.count("*").alias("n_queries"))
    return counts.select("query_class", profile.alias("profile"), X.profile_weights(profile)["dense"].alias("dense_weight"), "n_queries")


def _complexity_sql() -> str:
    hit = {k: f"list_has_any(w, [{', '.join(repr(x) for x in v)}])" for k, v in X.COMPLEXITY_SIGNALS.items()}
    hit["multi_concept"] += " OR n > 12"
    return f"""
WITH q AS (SELECT id, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+') AS every FROM ({QUESTIONS}) WHERE question IS NOT NULL),
w AS (SELECT id, len(every) AS n, list_filter(list_transform(every, lambda x: lower(x)), lambda x: x NOT IN {sql_list(X.COMPLEXITY_STOP)}) AS w FROM q),
s AS (SELECT id, list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in hit.items())}], lambda x: x IS NOT NULL) AS signals FROM w)
SELECT id, CASE len(signals) WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'complex' END AS level, array_to_string(signals, ',') AS signals,
       CASE len(signals) WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 10 END AS recommended_chunks, CASE len(signals) WHEN 0 THEN 500 WHEN 1 THEN 1500 ELSE 3000 END AS recommended_tokens FROM s"""


@query(_complexity_sql())
def query_complexity(t: Tables) -> DataFrame:
    """How complex each logged query is and how much context it should get."""
    return questions(t).where("question is not null").select("id", X.complexity(F.col("question")).alias("c")).select("id", "c.level", F.array_join("c.signals", ",").alias("signals"), "c.recommended_chunks", "c.recommended_tokens")


@query(rf"""
WITH q AS (SELECT id, {STRIP.format('question')} AS q FROM ({QUESTIONS}) WHERE question IS NOT NULL),
p AS (SELECT id, q, regexp_extract_all(q, '\b(?:19|20)\d{{2}}\b') AS years, list_filter(list_transform(string_split(q, '?'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS marks,
      list_filter(list_transform(regexp_split_to_array(q, '(?i)\s+and\s+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ands FROM q)
SELECT id, array_to_string(CASE
  WHEN len(years) >= 2 AND regexp_matches(q, '(?i)\b(compar|differ|change|changed|vs\.?|versus|between|from .+ to )\b') THEN list_append(list_transform(years[1:4], lambda y: 'What was ' || trim(regexp_replace(trim(lower(regexp_replace(regexp_replace(q, '\b(?:19|20)\d{{2}}\b', '', 'g'), '^[ ,?]+|[ ,?]+$', '', 'g'))), '^(how did|what was|how much did)\s+', '')) || ' in ' || y || '?'), 'What is the difference between ' || years[1] || ' and ' || years[2] || '?')[1:5]
  WHEN len(marks) > 1 THEN list_transform(marks[1:5], lambda x: x || '?')
  WHEN len(ands) > 1 THEN list_transform(ands[1:5], lambda x: regexp_replace(x, '\?+$', '') || '?')
  ELSE [CASE WHEN q LIKE '%?' THEN q ELSE q || '?' END] END, ' | ') AS sub_questions, length(q) AS n FROM p""")
def question_parts(t: Tables) -> DataFrame:
    """The sub-questions of each logged question."""
    parts = F.array_join(X.decompose(F.col("question")), " | ")
    return questions(t).where("question is not null").select("id", parts.alias("sub_questions"), F.length(X.strip(F.col("question"))).alias("n"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM s GROUP BY doc_id""")
def sentence_lengths(t: Tables) -> DataFrame:
    """Sentences of each document and the length of the longest."""
    return t.wide("documents", "doc_id", "text", "lang").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).alias("longest"))


@query(r"""
WITH f AS (SELECT id, answer, list_filter(regexp_extract_all(lower(query_text), '[\p{L}\p{N}_]+'), lambda x: x NOT IN """ + sql_list(X.STOPWORDS) + r""") AS kw FROM (SELECT DISTINCT id, answer, query_text FROM feedback_records) WHERE answer IS NOT NULL AND query_text IS NOT NULL),
s AS (SELECT id, answer, kw, list_filter(string_split(regexp_replace(answer, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM f),
u AS (SELECT id, answer, kw, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s),
r AS (SELECT id, answer, s, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+')), list_distinct(kw))) AS n, i FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY id, answer ORDER BY n DESC, i) AS k FROM r)
SELECT s.id, left(CASE WHEN b.n > 0 THEN b.s ELSE s.answer END, 300) AS highlight FROM s LEFT JOIN b ON s.id = b.id AND s.answer = b.answer AND b.k = 1""")
def answer_highlights(t: Tables) -> DataFrame:
    """The sentence of each answer in the feedback that shares most with its query."""
    rows = t.feedback_records.select("id", "answer", "query_text").distinct().where("answer is not null and query_text is not null")
    return rows.select("id", X.highlight(F.col("answer"), F.col("query_text")).alias("highlight"))


@query(r"""
WITH q AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
      CASE WHEN text = '' THEN 1.0 ELSE length(regexp_replace(text, '[\p{L}\p{Nd} \n\t.,;:!?\-''"()\[\]{}/@#%&*+=_<>|\\~`^]', '', 'g')) / length(text)::DOUBLE END AS noise FROM q),
m AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) = 0 THEN 0.0 ELSE length(array_to_string(ws, '')) / len(ws)::DOUBLE END AS mean FROM w),
s AS (SELECT doc_id, n, round(noise, 3) AS noise_ratio, round(greatest(0.0, 1 - (CASE WHEN n < 5 THEN 0.5 WHEN n < 20 THEN 0.2 ELSE 0.0 END + CASE WHEN noise > 0.4 THEN 0.4 WHEN noise > 0.2 THEN 0.15 ELSE 0.0 END
   + CASE WHEN mean < 2 AND n > 5 THEN 0.15 WHEN mean > 15 AND n > 5 THEN 0.1 ELSE 0.0 END + CASE WHEN lang IS NULL AND n >= 5 THEN 0.1 ELSE 0.0 END)), 3) AS score FROM m)
SELECT doc_id, n AS word_count, noise_ratio, score, CASE WHEN score >= 0.7 THEN 'ok' WHEN score >= 0.3 THEN 'warn' ELSE 'reject' END AS action FROM s""")
def document_quality(t: Tables) -> DataFrame:
    """Quality score and action for each document."""
    q = t.wide("documents", "doc_id", "text", "lang").select("doc_id", X.assess_quality(F.col("text"), F.col("lang")).alias("q"))
    return q.select("doc_id", "q.word_count", "q.noise_ratio", "q.score", "q.action")


def _topic_sql() -> str:
    unions = " UNION ALL ".join(f"SELECT '{k}' AS topic, unnest([{', '.join(repr(p) for p in v)}]) AS phrase" for k, v in X.TOPICS.items())
    return f"WITH k AS ({unions}), d AS (SELECT DISTINCT doc_id, lower(text) AS text FROM documents) SELECT topic, count(DISTINCT doc_id) AS n_docs FROM d JOIN k ON contains(d.text, k.phrase) GROUP BY topic"


@query(_topic_sql())
def document_topics(t: Tables) -> DataFrame:
    """How many documents have each topic."""
    return t.wide("documents", "doc_id", "text", "lang").select("doc_id", F.explode(X.topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.countDistinct("doc_id").alias("n_docs"))


@query(f"""
SELECT CASE ltrim(lower(trim(format)), '.') {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMATS.items())} ELSE 'text' END AS format,
       lower(left(trim(lang), 2)) AS lang, count(*) AS n_docs FROM documents GROUP BY ALL""")
def format_language_counts(t: Tables) -> DataFrame:
    """Documents by canonical format and language."""
    return t.documents.groupBy(canonical_format(F.col("format")).alias("format"), language_key(F.col("lang")).alias("lang")).agg(F.count("*").alias("n_docs"))


@query(f"""
WITH n AS (SELECT doc_id, document_id || CASE WHEN format LIKE '.%' THEN format ELSE '.' || format END AS filename FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(lower(filename), '\\.([^.]+)$', 1) IN {sql_list(list(FORMATS))} THEN regexp_extract(lower(filename), '\\.([^.]+)$', 1) ELSE 'text' END AS detected FROM n""")
def detected_formats(t: Tables) -> DataFrame:
    """The format detected from each document's file name."""
    name = F.concat("document_id", F.when(F.col("format").startswith("."), F.col("format")).otherwise(F.concat(F.lit("."), "format")))
    return t.documents.select("doc_id", detect_format(name, F.lit(None).cast("string")).alias("detected"))


@query("""SELECT regexp_replace(lower(trim(source)), '[ _]', '-', 'g') AS source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, strftime(max(ingested_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS latest FROM documents GROUP BY 1""")
def source_sizes(t: Tables) -> DataFrame:
    """Documents, characters and latest ingestion of each source."""
    return t.documents.groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query(r"""
SELECT doc_id, upper(lang) AS upper_lang, lower(source) AS lower_source, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS stripped, 'doc-' || document_id AS prefixed, document_id || '.txt' AS suffixed,
       coalesce(n_chars, 0) * 2.5 AS multiplied, coalesce(n_chars, 0) + 7 AS added, 'corpus' AS constant FROM documents""")
def processing_operations(t: Tables) -> DataFrame:
    """The elementary operations of a processing step on each document."""
    c = F.col
    return t.documents.select(
        "doc_id", F.upper("lang").alias("upper_lang"), F.lower("source").alias("lower_source"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("stripped"), F.concat(F.lit("doc-"), c("document_id")).alias("prefixed"),
        F.concat(c("document_id"), F.lit(".txt")).alias("suffixed"), (F.coalesce(c("n_chars"), F.lit(0)) * 2.5).alias("multiplied"), (F.coalesce(c("n_chars"), F.lit(0)) + 7).alias("added"), F.lit("corpus").alias("constant"),
    )


@query(r"""
WITH m AS (SELECT DISTINCT id, array_to_string(list_distinct(regexp_extract_all(answer, '\[\d+\]')), ' ') AS x, regexp_extract_all(answer, '\[\d+\]') AS a FROM query_logs WHERE answer IS NOT NULL)
SELECT id, len(list_distinct(a)) AS n_markers, coalesce(a[1], '') AS first_marker FROM m""")
def answer_citations(t: Tables) -> DataFrame:
    """Citation markers of each answer."""
    marks = X.citation_markers(F.col("answer"))
    return t.query_logs.where("answer is not null").select("id", "answer").distinct().select("id", F.size(marks).alias("n_markers"), F.coalesce(F.try_element_at(marks, F.lit(1)), F.lit("")).alias("first_marker"))
