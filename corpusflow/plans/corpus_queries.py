"""Queries over stores, chunks, graphs, conditions, parsers and streams."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusflow.functions.conditions import classified, condition, first_case
from corpusflow.functions.keys import source_key
from corpusflow.functions.text import slug
from corpusflow.operators import chunking as H
from corpusflow.operators import graph as G
from corpusflow.operators import store as V
from corpusflow.plans.registry import Tables, query
from corpusflow.sources import parsers as P
from corpusflow.streaming import events as E


def records(t: Tables) -> DataFrame:
    """(store_name, namespace, id, created_at, dimension, fingerprint) of the vector table; vectors stay behind."""
    return t.vector_chunks.where("id is not null").select("store_name", "namespace", "id", "created_at", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimension"))


RECORDS = "rec AS (SELECT store_name, namespace, id, created_at, coalesce(len(embedding), 0) AS dimension FROM vector_chunks WHERE id IS NOT NULL)"
LAST = f"""WITH {RECORDS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_name, namespace, id ORDER BY created_at DESC NULLS LAST, dimension DESC) AS n FROM rec) WHERE n = 1)"""


def last(t: Tables) -> DataFrame:
    return V.last_write(records(t), "created_at", "dimension")


@query(LAST + " SELECT store_name, namespace, id, dimension FROM last")
def store_last_write(t: Tables) -> DataFrame:
    """The store after all writes, the last of each key winning."""
    return last(t).select("store_name", "namespace", "id", "dimension")


@query(LAST + ", old AS (SELECT * FROM last WHERE id NOT LIKE '%::0'), new AS (SELECT * FROM last WHERE id LIKE '%::0' OR id LIKE '%::1') SELECT store_name, count(*) AS n_vectors, count_if(fresh)::BIGINT AS n_fresh FROM (SELECT store_name, true AS fresh FROM new UNION ALL SELECT store_name, false FROM old WHERE NOT (id LIKE '%::1')) GROUP BY store_name")
def store_upsert(t: Tables) -> DataFrame:
    """A store of later chunks after first and second chunks were put in."""
    rows = last(t).withColumn("fresh", F.lit(False))
    first, second = F.col("id").endswith("::0"), F.col("id").endswith("::1")
    merged = V.upsert(rows.where(~first), rows.where(first | second).withColumn("fresh", F.lit(True)))
    return merged.groupBy("store_name").agg(F.count("*").alias("n_vectors"), F.count_if("fresh").alias("n_fresh"))


@query(LAST + " SELECT store_name, namespace, count(*) AS n_vectors FROM last WHERE namespace IS NULL OR id NOT LIKE '%::0' GROUP BY ALL")
def store_delete(t: Tables) -> DataFrame:
    """What is left of each namespace without first chunks; a null namespace has no ids that could be named."""
    rows = last(t)
    return V.delete(rows, rows.where(F.col("id").endswith("::0"))).groupBy("store_name", "namespace").agg(F.count("*").alias("n_vectors"))


@query(LAST + " SELECT store_name, namespace, count(*) AS n_vectors, max(dimension) AS dimension, CASE WHEN count(*) < 10000 THEN 'flat' WHEN count(*) < 1000000 THEN 'hnsw' ELSE 'ivf' END AS index_type FROM last GROUP BY ALL")
def store_statistics(t: Tables) -> DataFrame:
    """Vectors, dimension and fitting index of each namespace."""
    return V.namespace_stats(last(t))


@query("""SELECT vec_id, round(CASE WHEN sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0 THEN 1.0 ELSE 0.0 END, 6) AS norm, round(list_sum(embedding::DOUBLE[]) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS total FROM embeddings""")
def normalized_vectors(t: Tables) -> DataFrame:
    """Length and sum of each vector after normalising."""
    v = V.normalized(F.col("embedding"))
    add = lambda s, x: s + x
    return t.embeddings.select("vec_id", F.round(F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add)), 6).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), add), 5).alias("total"))


def texts(t: Tables) -> DataFrame:
    return t.wide("documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")


@query("""WITH c AS (SELECT doc_id AS id, text, unnest(range(0, greatest(0, ceil((length(text) - 400) / 350.0))::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0),
p AS (SELECT id, i, substring(text, (i * 350 + 1)::BIGINT, 400) AS t, count(*) OVER (PARTITION BY id) AS n FROM c)
SELECT id || '::' || i AS chunk_id, i::INT AS chunk_index, (i * 350)::INT AS start_char, (i * 350 + length(t))::INT AS end_char, length(t)::INT AS char_count, greatest(1, length(t) // 4) AS token_estimate, md5(t) AS digest,
  CASE WHEN n = 1 THEN 'only' WHEN i = 0 THEN 'first' WHEN i = n - 1 THEN 'last' ELSE 'middle' END AS position FROM p""")
def chunks_fixed(t: Tables) -> DataFrame:
    """Windows of 400 characters that overlap by 50."""
    c = H.chunk_documents(texts(t), "fixed", 400, 50)
    return c.select("chunk_id", "chunk_index", "start_char", "end_char", "char_count", "token_estimate", F.md5(F.col("text").cast("binary")).alias("digest"), "position")


@query()
def chunks_by_strategy(t: Tables) -> DataFrame:
    """Number and sizes of chunks that each strategy makes of the documents."""
    rows = None
    for name in ("fixed", "recursive", "semantic", "structure", "code"):
        part = H.chunk_documents(texts(t), name, 400).select(F.lit(name).alias("strategy"), "char_count", "token_estimate")
        rows = part if rows is None else rows.unionByName(part)
    return H.chunk_summary(rows, ["strategy"])


@query()
def chunks_by_structure(t: Tables) -> DataFrame:
    """Chunks at Markdown headings, with heading and level."""
    return H.chunk_documents(texts(t), "structure", 800).where("heading is not null").select("chunk_id", "heading", "level", "start_char", "char_count")


@query("""SELECT chunk_strategy, count(*) AS n_docs FROM (SELECT CASE WHEN format IN ('pptx', '.pptx') OR contains(text, '### Slide') THEN 'structure' WHEN format IN ('xlsx', '.xlsx') OR contains(left(text, 500), chr(9)) THEN 'fixed'
  WHEN contains(left(text, 200), '#') AND contains(text, chr(10) || '#') THEN 'structure' WHEN contains(left(text, 500), 'def ') OR contains(left(text, 500), 'class ') OR contains(left(text, 500), 'function ') OR contains(left(text, 500), 'func ') THEN 'code'
  WHEN length(text) < 2000 THEN 'semantic' ELSE 'recursive' END AS chunk_strategy FROM (SELECT lower(format) AS format, text FROM documents)) GROUP BY 1""")
def chunk_advice(t: Tables) -> DataFrame:
    """How many documents each strategy is advised for."""
    name = F.concat(F.lit("x."), F.regexp_replace(F.lower("format"), r"^\.", ""))
    return t.documents.groupBy(H.recommended_strategy(name, F.col("text")).alias("chunk_strategy")).agg(F.count("*").alias("n_docs"))


@query("""WITH c AS (SELECT DISTINCT document_id, chunk_id, char_count, length(text) AS n, token_estimate FROM chunks WHERE chunk_id IS NOT NULL)
SELECT document_id IN (SELECT document_id FROM documents) AS known, count(*) AS n_chunks, count_if(n <> char_count)::BIGINT AS n_wrong_length, count_if(token_estimate IS NULL OR token_estimate <> greatest(1, n // 4))::BIGINT AS n_wrong_estimate FROM c GROUP BY 1""")
def chunk_audit(t: Tables) -> DataFrame:
    """Chunks of known and unknown documents and those whose recorded sizes are wrong."""
    c = t.chunks.where("chunk_id is not null").select("document_id", "chunk_id", "char_count", F.length("text").alias("n"), "token_estimate").distinct()
    known = t.documents.select("document_id", F.lit(True).alias("k")).distinct()
    joined = c.join(known, "document_id", "left").withColumn("known", F.coalesce("k", F.lit(False)))
    estimate = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return joined.groupBy("known").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("n") != F.col("char_count")).alias("n_wrong_length"), F.count_if(F.col("token_estimate").isNull() | (F.col("token_estimate") != estimate)).alias("n_wrong_estimate"))


def edges(t: Tables) -> DataFrame:
    """(subject_id, predicate, object_id): nations in regions, customers and suppliers in nations, orders by customers."""
    link = lambda d, a, ka, p, b, kb: d.select(F.concat(F.lit(a), F.col(ka)).alias("subject_id"), F.lit(p).alias("predicate"), F.concat(F.lit(b), F.col(kb)).alias("object_id"))
    parts = [link(t.nation, "nation:", "n_nationkey", "in_region", "region:", "n_regionkey"), link(t.customer, "customer:", "c_custkey", "in_nation", "nation:", "c_nationkey"), link(t.supplier, "supplier:", "s_suppkey", "in_nation", "nation:", "s_nationkey"), link(t.orders, "order:", "o_orderkey", "placed_by", "customer:", "o_custkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = """e AS (SELECT 'nation:' || n_nationkey AS s, 'in_region' AS p, 'region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'in_nation', 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders)"""


@query(f"""WITH {EDGES}, d AS (SELECT s AS entity_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT o, 1, 0 FROM e) SELECT entity_id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS degree FROM d GROUP BY entity_id""")
def graph_degrees(t: Tables) -> DataFrame:
    """Edges at each entity of the trade graph."""
    return G.degrees(edges(t))


@query(f"""WITH {EDGES}, f AS (SELECT 'nation:' || n_nationkey AS id FROM nation)
SELECT DISTINCT id AS entity_id, o AS neighbour, p AS predicate, 'out' AS direction FROM f JOIN e ON s = id UNION SELECT id, s, p, 'in' FROM f JOIN e ON o = id""")
def graph_neighbours(t: Tables) -> DataFrame:
    """Neighbours of every nation."""
    return G.neighbours(edges(t), t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("entity_id")))


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT 'order:' || o_orderkey AS start, 'order:' || o_orderkey AS id, 0 AS depth, 'order:' || o_orderkey AS path FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT start, e.o, depth + 1, path || ' > ' || e.o FROM w JOIN e ON e.s = w.id WHERE depth < 4) SELECT start, id AS entity_id, min(depth)::INT AS depth, min_by(path, depth) AS path FROM w GROUP BY ALL""")
def graph_shortest_paths(t: Tables) -> DataFrame:
    """What every fiftieth order leads to, over how many edges, and which way."""
    found = G.shortest_paths(edges(t), t.orders.where("o_orderkey % 50 = 0").select(F.concat(F.lit("order:"), "o_orderkey").alias("entity_id")))
    return found.withColumn("path", F.array_join("path", " > "))


def _mentions_sql() -> str:
    found = lambda kind, pattern, group=0: f"SELECT id, '{kind}' AS type, unnest(regexp_extract_all(text, '{pattern}', {group})) AS name FROM x"
    bare = "regexp_replace(regexp_replace(name, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '[,.]+$', '')"
    # Word borders are those of all letters; DuckDB knows ASCII ones only, so other letters are read as an underscore there.
    letters = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{52F}]"
    return f"""x AS (SELECT doc_id AS id, regexp_replace(text, '{letters}', '_', 'g') AS text FROM documents WHERE text IS NOT NULL),
o AS ({found('ORGANIZATION', G.ORGANIZATION)}), te AS ({found('TECHNOLOGY', G.TECHNOLOGY)}), pl AS (SELECT id, type, {bare} AS name FROM ({found('PLACE', G.PLACE, 1)})), pe AS ({found('PERSON', G.PERSON)}),
every AS (SELECT * FROM o UNION ALL SELECT * FROM te UNION ALL {found('DATE', G.DATE)} UNION ALL {found('NUMBER', G.NUMBER)} UNION ALL SELECT * FROM pl WHERE length(name) BETWEEN 3 AND 49
  UNION ALL SELECT * FROM pe WHERE (id, name) NOT IN (SELECT id, name FROM o UNION ALL SELECT id, name FROM te)),
m AS (SELECT id, type, type || ':' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS entity_id, min(name) AS name FROM every GROUP BY ALL),
known AS (SELECT entity_id, type, min(name) AS name, count(DISTINCT id) AS n_docs FROM m GROUP BY ALL)"""


MENTIONS = _mentions_sql()


def mentioned(t: Tables) -> DataFrame:
    return G.mentions(texts(t).where("text is not null"))


@query(f"WITH {MENTIONS} SELECT entity_id, type, name, n_docs FROM known")
def graph_entities(t: Tables) -> DataFrame:
    """Entities named in the documents and in how many."""
    return G.entities(mentioned(t))


@query(f"WITH {MENTIONS} SELECT type, count(*) AS n_entities, sum(n_docs)::BIGINT AS n_mentions FROM known GROUP BY type")
def graph_entity_types(t: Tables) -> DataFrame:
    """Different entities of each type."""
    return G.entities(mentioned(t)).groupBy("type").agg(F.count("*").alias("n_entities"), F.sum("n_docs").alias("n_mentions"))


@query()
def graph_relations(t: Tables) -> DataFrame:
    """What the documents' sentences state of the entities in them."""
    return G.relations(texts(t).where("text is not null"), mentioned(t))


@query(f"""WITH {MENTIONS}, a AS (SELECT unnest([1, 2, 3]) AS query_id, lower(unnest(['Orvane', 'API', '2025'])) AS n), h AS (SELECT DISTINCT query_id, entity_id, n_docs FROM known, a WHERE contains(lower(name), n) OR contains(n, lower(name)))
SELECT query_id, entity_id, n_docs, row_number() OVER (PARTITION BY query_id ORDER BY n_docs DESC, entity_id)::INT AS rank FROM h QUALIFY rank <= 10""")
def graph_search(t: Tables) -> DataFrame:
    """Entities that match names."""
    asked = t.spark.createDataFrame([(1, "Orvane"), (2, "API"), (3, "2025")], "query_id int, name string")
    return G.graph_search(asked, G.entities(mentioned(t)))


RULES = {"op": "and", "conditions": [{"op": "or", "conditions": [{"op": "==", "left": "$.lang", "right": "en"}, {"op": "startswith", "left": "$.lang", "right": "en"}]}, {"op": ">", "left": "$.n_chars", "right": 500}, {"op": "not", "condition": {"op": "contains", "left": "$.source", "right": "archive"}}, {"op": "in", "left": "$.format", "right": ["markdown", "html", "text"]}]}


@query("""SELECT doc_id FROM documents WHERE coalesce(lang = 'en' OR starts_with(lang, 'en'), false) AND n_chars > 500 AND NOT coalesce(contains(source, 'archive'), false) AND format IN ('markdown', 'html', 'text')""")
def filtered_documents(t: Tables) -> DataFrame:
    """Documents for which a nested condition holds."""
    return t.documents.where(condition(RULES)).select("doc_id")


@query("""SELECT CASE WHEN lower(format) IN ('xlsx', '.xlsx', 'pptx', '.pptx') THEN 'office' WHEN n_chars < 200 THEN 'short' WHEN contains(lower(text), 'invoice') OR contains(lower(text), 'rechnung') THEN 'billing' ELSE 'general' END AS route,
 CASE WHEN regexp_matches(lower(coalesce(source, '')), 'legal|contracts') THEN 0.9 WHEN coalesce(n_chars > 3000, false) THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, count(*) AS n_docs FROM documents GROUP BY ALL""")
def routed_documents(t: Tables) -> DataFrame:
    """Documents by route and confidence of their class."""
    low = t.documents.withColumn("fmt", F.lower("format")).withColumn("low", F.lower("text")).withColumn("src", F.lower(F.coalesce("source", F.lit(""))))
    office = {"op": "in", "left": "$.fmt", "right": ["xlsx", ".xlsx", "pptx", ".pptx"]}
    billing = {"op": "or", "conditions": [{"op": "contains", "left": "$.low", "right": "invoice"}, {"op": "contains", "left": "$.low", "right": "rechnung"}]}
    route = first_case([(office, "office"), ({"op": "<", "left": "$.n_chars", "right": 200}, "short"), (billing, "billing")], "general")
    kind = classified([({"op": "regex", "left": "$.src", "right": "legal|contracts"}, "legal", 0.9), ({"op": ">", "left": "$.n_chars", "right": 3000}, "long", None)], {"long": 0.7})
    return low.groupBy(route.alias("route"), kind["confidence"].alias("confidence")).agg(F.count("*").alias("n_docs"))


@query("""SELECT doc_id, 'title: ' || json_extract_string(metadata, '$.title') AS title_line FROM documents WHERE json_extract_string(metadata, '$.title') IS NOT NULL""")
def metadata_lines(t: Tables) -> DataFrame:
    """The line of the title among those that each document's metadata flattens to."""
    title = F.get_json_object("metadata", "$.title")
    lines = P.json_to_lines("metadata")
    head = F.concat(F.lit("title: "), title)
    return t.documents.where(title.isNotNull()).select("doc_id", F.when(F.contains(lines, head), head).alias("title_line"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]') THEN length(text) ELSE 0 END + 1 AS n_chars FROM documents WHERE text IS NOT NULL")
def html_round_trip(t: Tables) -> DataFrame:
    """Lengths of the documents' texts after a trip through HTML."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p>"), escaped, F.lit("</p></body></html>"))
    return t.documents.where("text is not null").select("doc_id", F.length(P.html_to_text(page)).alias("n_chars"))


@F.pandas_udf(BinaryType())
def packed_docx(texts: pd.Series) -> pd.Series:
    """A word processor's file with each line of a text as a paragraph."""

    def pack(text: str) -> bytes:
        lines = "".join(f"<w:p><w:r><w:t>{html.escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            archive.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{lines}</w:body></w:document>')
        return held.getvalue()

    return texts.map(pack)


BARE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


@query(rf"""SELECT doc_id, f.format, md5(regexp_replace(text, '{BARE}', '', 'g')) AS digest, CASE f.format WHEN 'html' THEN 'A page' END AS title, NULL::VARCHAR AS error, CASE f.format WHEN 'xml' THEN 'doc' END AS root_tag
FROM documents, (SELECT unnest(['text', 'markdown', 'json', 'xml', 'html', 'docx']) AS format) f WHERE NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]')""")
def parsed_files(t: Tables) -> DataFrame:
    """The documents as files of six formats, read again: a digest of the text, the title, and what went wrong."""
    docs = t.wide("documents", "doc_id", "text").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"))
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tagged = lambda a, b: F.concat(F.lit(a), escaped, F.lit(b))
    made = {"text": F.col("text"), "markdown": F.col("text"), "json": F.to_json(F.struct(F.col("text").alias("t"))), "xml": tagged("<doc><t>", "</t></doc>"), "html": tagged("<html><head><title>A page</title></head><body><p>", "</p></body></html>")}
    files = F.array(*[F.struct(F.lit(k).alias("format"), F.encode(c, "utf-8").alias("content")) for k, c in made.items()], F.struct(F.lit("docx").alias("format"), packed_docx("text").alias("content")))
    each = docs.select(F.col("doc_id").alias("id"), F.explode(files).alias("f")).select("id", "f.*")
    read = P.parse_files(each)
    text = F.when(F.col("format") == "json", F.regexp_replace("text", "^t: ", "")).otherwise(F.col("text"))
    root = each.where("format = 'xml'").select("id", "format", P.xml_root_tag("content").alias("root_tag"))
    parsed = read.select("id", "format", F.md5(F.regexp_replace(text, BARE, "").cast("binary")).alias("digest"), "title", "error")
    return parsed.join(root, ["id", "format"], "left").withColumnRenamed("id", "doc_id")


@query(r"""WITH c AS (SELECT doc_id AS id, text, format, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS clean FROM documents WHERE text IS NOT NULL)
SELECT id, substr(sha1(text), 1, 16) AS document_id, strlen(text) AS file_size, length(clean) AS char_count, len(list_filter(regexp_split_to_array(clean, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS word_count, greatest(1, length(clean) // 4) AS token_estimate, NULL::VARCHAR AS error FROM c""")
def ingested_files(t: Tables) -> DataFrame:
    """The documents taken in as text files: their keys, sizes and counts."""
    files = t.wide("documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"), F.lit("text").alias("format"))
    return P.ingest(files).select("id", "document_id", F.col("file_size").cast("long").alias("file_size"), F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"), "token_estimate", "error")


@query("SELECT regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n_docs FROM documents WHERE source IS NOT NULL GROUP BY 1")
def source_slugs(t: Tables) -> DataFrame:
    """Documents by slug of their source."""
    return t.documents.where("source is not null").groupBy(slug(F.col("source")).alias("slug")).agg(F.count("*").alias("n_docs"))


@query("""WITH k AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT first AS doc_id, n AS n_copies FROM k WHERE n > 1""")
def embedding_cache(t: Tables) -> DataFrame:
    """Texts that an embedding cache saves computing again: the first document of each and how many share it."""
    return t.documents.where("text is not null").groupBy(F.sha1(F.col("text").cast("binary")).alias("key")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("doc_id")).where("n_copies > 1").select("doc_id", "n_copies")


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def stream_event_windows(t: Tables) -> DataFrame:
    """Events by hour and type, counted by a stream."""
    out = E.complete_result(E.event_windows(E.read_stream(t.spark, f"{t.sf_dir}/events.parquet")))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM s GROUP BY user_id, k""")
def event_sessions(t: Tables) -> DataFrame:
    """Sessions of each user's events."""
    return E.sessions(t.events).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events")


@query("""SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS spent, sum(value) > 5000 AS over FROM events GROUP BY user_id""")
def stream_running_totals(t: Tables) -> DataFrame:
    """Each user's running totals after the stream's last batch."""
    spark = t.spark
    stream = E.running_totals(E.read_stream(spark, f"{t.sf_dir}/events.parquet").select("user_id", "value"), 5000.0)
    folder = E.shared_folder(spark, f"totals-{E.uuid.uuid4().hex}")
    E.run_to_end(stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/part={n}")), f"{folder}/checkpoint")
    rows = spark.read.parquet(f"{folder}/out/part=*")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n_events", "spent", "over"), "batch").alias("r")).select("user_id", "r.*")


@query("""WITH r AS (SELECT id, store_name, namespace, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS written, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, store_name DESC NULLS LAST, namespace DESC NULLS LAST) AS n FROM vector_chunks WHERE id IS NOT NULL)
SELECT id, store_name, namespace, written FROM r WHERE n = 1""")
def stream_upsert(t: Tables) -> DataFrame:
    """The rows that have won in a store into which a stream of vector rows was merged in several batches, out of order."""
    spark = t.spark
    folder = E.shared_folder(spark, f"store-{E.uuid.uuid4().hex}")
    rows = t.vector_chunks.select("id", "store_name", "namespace", "created_at")
    # As several files, read one a batch, over which the versions of an id are spread.
    rows.repartition(4, F.xxhash64("id", "created_at", "namespace")).write.parquet(f"{folder}/arrivals")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    E.upsert_stream(stream, f"{folder}/store", f"{folder}/checkpoint")
    return E.read_store(spark, f"{folder}/store").select("id", "store_name", "namespace", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("written"))


@query("""WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events, round(sum(value), 4) AS value FROM w GROUP BY ALL""")
def stream_sliding_windows(t: Tables) -> DataFrame:
    """Events by type in windows of two hours that start every hour, counted by a stream."""
    out = E.complete_result(E.sliding_windows(E.read_stream(t.spark, f"{t.sf_dir}/events.parquet")))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT lower(trim(provider)) AS provider, count(DISTINCT id) AS n_entries FROM query_logs WHERE id IS NOT NULL GROUP BY 1")
def stream_distinct_entries(t: Tables) -> DataFrame:
    """Log entries by provider, those that came again counted once by a stream."""
    stream = E.read_stream(t.spark, f"{t.sf_dir}/query_logs.parquet").where("id is not null").select("id", "provider", "received_at")
    return E.appended(E.first_of_each(stream, ["id"], "received_at", "30 days")).groupBy(F.lower(F.trim("provider")).alias("provider")).agg(F.count("*").alias("n_entries"))


@query("""SELECT count(*) AS n_met, count(DISTINCT f.id) AS n_feedback FROM (SELECT DISTINCT id, query_id, submitted_at FROM feedback_records) f JOIN (SELECT DISTINCT id, created_at FROM query_logs) q ON q.id = f.query_id
WHERE f.submitted_at BETWEEN q.created_at AND q.created_at + INTERVAL 2 DAY""")
def stream_feedback_join(t: Tables) -> DataFrame:
    """Feedback that came within two days of its question, by a join of two streams."""
    asked = E.read_stream(t.spark, f"{t.sf_dir}/query_logs.parquet").select(F.col("id").alias("query_id"), "created_at")
    told = E.read_stream(t.spark, f"{t.sf_dir}/feedback_records.parquet").select("query_id", F.col("id").alias("feedback_id"), "submitted_at")
    met = E.appended(E.joined_within(asked, told, ["query_id"], "created_at", "submitted_at", "2 days")).distinct()
    return met.agg(F.count("*").alias("n_met"), F.countDistinct("feedback_id").alias("n_feedback"))
