"""Knowledge graphs: entities and relations from texts, neighbours, degrees, shortest paths and search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusflow.functions.text import slug, strip
from corpusflow.session import broadcast_if_small, checkpointed

# How entities of each type are written.
ORGANIZATION = r"\b(?:[A-Z][A-Za-z0-9&\-]+(?:\s+[A-Z][A-Za-z0-9&\-]+)*)\s+(?:Corp|Corporation|Inc|Incorporated|Ltd|Limited|LLC|LLP|Company|Group|Holdings|Partners|Associates|Technologies|Solutions|Services|Systems|Labs|Institute|Foundation|Agency)\b"
TECHNOLOGY = r"\b(?:Python|JavaScript|TypeScript|Java|C\+\+|Rust|Go|Kotlin|Swift|React|Angular|Vue|Node\.js|FastAPI|Django|Flask|PostgreSQL|MySQL|MongoDB|Redis|Elasticsearch|AWS|Azure|GCP|Docker|Kubernetes|Terraform|GPT|ChatGPT|Claude|Gemini|LLM|AI|ML|NLP|API|SDK|REST|GraphQL|gRPC|OAuth|JWT)\b"
DATE = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{4}s?|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
NUMBER = r"\$[\d.,]+[MBKmb]?|\b\d+(?:\.\d+)?\s*%"
PLACE = r"(?i)(?:in|at|from|near|based\s+in)\s+([A-Z][a-zA-Z\s,]{2,40}?)(?:[,.]|$)"
PERSON = r"\b(?:[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){1,3})\b"
# Verb phrases and the predicates that they state.
PREDICATES = {
    r"is(?:\s+the)?\s+ceo\s+of": "is_ceo_of",
    r"is(?:\s+the)?\s+cto\s+of": "is_cto_of",
    r"is(?:\s+the)?\s+cfo\s+of": "is_cfo_of",
    r"is(?:\s+the)?\s+founder\s+of": "founded",
    r"founded": "founded",
    r"works?\s+(?:at|for)": "works_at",
    r"employed\s+(?:at|by)": "works_at",
    r"manages?": "manages",
    r"leads?": "leads",
    r"heads?": "leads",
    r"owned\s+by": "owned_by",
    r"acquired": "acquired",
    r"merged\s+with": "merged_with",
    r"partnered\s+with": "partners_with",
    r"is\s+located\s+in": "located_in",
    r"headquartered\s+in": "located_in",
    r"based\s+in": "located_in",
    r"operates?\s+in": "operates_in",
    r"announced": "announced",
    r"launched": "launched",
    r"developed?": "developed",
    r"uses?": "uses",
    r"integrates?\s+with": "integrates_with",
    r"powers?": "powers",
    r"specialises?\s+in": "specialises_in",
    r"specializes?\s+in": "specialises_in",
    r"invested\s+in": "invested_in",
    r"funded\s+by": "funded_by",
    r"reported": "reported",
    r"contributed\s+to": "contributed_to",
}


def mentions(texts: DataFrame) -> DataFrame:
    """(doc_id, type, name, entity_id) of the different entities in each (id, text); ids are unique and each text is read once.

    A person's name that is an organisation's or a technology's in the same text is none.
    """
    every = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    bare = lambda name: F.regexp_replace(strip(name), "[,.]+$", "")
    found = texts.select(
        F.col("id").alias("doc_id"), F.transform(every(ORGANIZATION), strip).alias("ORGANIZATION"), every(TECHNOLOGY).alias("TECHNOLOGY"), every(DATE).alias("DATE"), every(NUMBER).alias("NUMBER"),
        F.filter(F.transform(every(PLACE, 1), bare), lambda n: F.length(n).between(3, 49)).alias("PLACE"), every(PERSON).alias("PERSON"),
    ).withColumn("PERSON", F.array_except("PERSON", F.concat("ORGANIZATION", "TECHNOLOGY")))
    kinds = ("ORGANIZATION", "TECHNOLOGY", "DATE", "NUMBER", "PLACE", "PERSON")
    typed = lambda kind: F.transform(F.array_distinct(kind), lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))
    named = F.flatten(F.array(*map(typed, kinds)))
    each = found.select("doc_id", F.explode(named).alias("e")).select("doc_id", "e.*")
    return each.withColumn("entity_id", F.concat("type", F.lit(":"), slug(F.col("name")))).groupBy("doc_id", "type", "entity_id").agg(F.min("name").alias("name"))


def entities(found: DataFrame) -> DataFrame:
    """(entity_id, type, name, n_docs) of all texts' mentions."""
    return found.groupBy("entity_id", "type").agg(F.min("name").alias("name"), F.countDistinct("doc_id").alias("n_docs"))


_TRIPLES = ArrayType(StructType([StructField(n, StringType()) for n in ("subject_id", "predicate", "object_id")]))
_COMPILED = [(re.compile(rf"\b{p}\b", re.I), name) for p, name in PREDICATES.items()]
_GAP = re.compile(r"(?<=[.!?])\s+")


def triples_of(text: str, named: list[tuple[str, str]]) -> set[tuple[str, str, str]]:
    """(subject, predicate, object): the entities nearest before and after the first of each phrase in a sentence.

    ``named`` has lower-case names and ids.
    """
    out = set()
    for sentence in _GAP.split(text):
        low = sentence.lower()
        here = [(low.find(n), n, i) for n, i in named if n in low]
        if len(here) < 2:
            continue
        for pattern, predicate in _COMPILED:
            m = pattern.search(sentence)
            if not m:
                continue
            before = max(((at, i) for n, i in named if (at := low.rfind(n, 0, m.start())) >= 0), key=lambda x: x[0], default=None)
            after = min(((at, i) for n, i in named if (at := low.find(n, m.end())) >= 0), key=lambda x: x[0], default=None)
            if before and after and before[1] != after[1]:
                out.add((before[1], predicate, after[1]))
    return out


def relations(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(subject_id, predicate, object_id, n_docs): triples of each text's own entities, over all texts."""

    @F.pandas_udf(_TRIPLES)
    def triples(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, named in batches:
            yield pd.Series([[dict(zip(("subject_id", "predicate", "object_id"), x)) for x in sorted(triples_of(b, [(n["name"].lower(), n["entity_id"]) for n in sorted(ns, key=lambda n: (-len(n["name"]), n["name"]))]))] for b, ns in zip(bodies, named)])

    # Only texts with two entities or more can relate any.
    named = found.groupBy("doc_id").agg(F.collect_list(F.struct("name", "entity_id")).alias("named")).where(F.size("named") > 1)
    joined = texts.join(named, texts["id"] == named["doc_id"]).select("doc_id", F.explode(triples("text", "named")).alias("t"))
    return joined.select("doc_id", "t.*").groupBy("subject_id", "predicate", "object_id").agg(F.countDistinct("doc_id").alias("n_docs"))


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(entity_id, neighbour, predicate, direction) of edges (subject_id, predicate, object_id) at the given entity_ids."""
    out = edges.join(of, edges["subject_id"] == of["entity_id"]).select("entity_id", F.col("object_id").alias("neighbour"), "predicate", F.lit("out").alias("direction"))
    back = edges.join(of, edges["object_id"] == of["entity_id"]).select("entity_id", F.col("subject_id").alias("neighbour"), "predicate", F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, n_in, n_out, degree)."""
    ends = edges.select(F.col("subject_id").alias("entity_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("object_id", F.lit(1), F.lit(0)))
    return ends.groupBy("entity_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def merged_entities(found: DataFrame) -> DataFrame:
    """(entity_id, type, name, aliases, n_docs, first_doc, last_doc) of mentions (doc_id, type, entity_id, name) added in the order of documents.

    The first name met stands, and other spellings become aliases in the order that they were met. Which documents an entity
    is in stays a table of rows, ``found`` itself, as a common entity is in any number of them.
    """
    spelled = found.groupBy("entity_id", "type", "name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"])
    merged = spelled.groupBy("entity_id", "type").agg(names.alias("names"), F.sum("n").alias("n_docs"), F.min("first").alias("first_doc"), F.max("last").alias("last_doc"))
    return merged.select("entity_id", "type", F.element_at("names", 1).alias("name"), F.slice("names", F.lit(2), F.size("names")).alias("aliases"), "n_docs", "first_doc", "last_doc")


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 4) -> DataFrame:
    """(start, entity_id, depth, path) of all that each start reaches by up to ``max_depth`` edges, itself at 0.

    ``path`` holds the entities on the way, both ends included; of equally long ways the first in the alphabet. Breadth
    first: each step joins the last frontier with the edges and drops what was reached before.
    """
    hops = edges.select(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("next")).distinct()
    reached = frontier = starts.select(F.col("entity_id").alias("start"), "entity_id", F.lit(0).alias("depth"), F.array("entity_id").alias("path")).distinct()
    for depth in range(1, max_depth + 1):
        ways = frontier.join(hops, "entity_id").select("start", F.col("next").alias("entity_id"), F.concat("path", F.array("next")).alias("path"))
        new = ways.groupBy("start", "entity_id").agg(F.min("path").alias("path")).join(reached.select("start", "entity_id"), ["start", "entity_id"], "left_anti")
        frontier = checkpointed(new.select("start", "entity_id", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def graph_search(asked: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, entity_id, n_docs, rank): entities whose name holds, or is held by, one of a query's (query_id, name), by documents.

    ``asked`` is a handful of names, joined to every entity.
    """
    low, name = F.lower(known["name"]), F.lower("asked_name")
    asked = broadcast_if_small(asked.select("query_id", F.col("name").alias("asked_name")))
    hits = known.join(asked, F.contains(low, name) | F.contains(name, low)).select("query_id", "entity_id", "n_docs").distinct()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_docs").desc(), "entity_id"))).where(F.col("rank") <= k)
