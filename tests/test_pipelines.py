"""Folds, places, caches, stores, graphs, values and pages against rules written out by hand."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from corpusflow.functions import values as U
from corpusflow.functions.keys import week_of
from corpusflow.functions.text import decompose, slug
from corpusflow.operators import analytics as A
from corpusflow.operators import graph as G
from corpusflow.operators import ranking as R
from corpusflow.operators import rerank as K
from corpusflow.operators import search as S
from corpusflow.operators import store as V
from corpusflow.operators.chunking import by_structure
from corpusflow.operators.context import build_prompt, organize
from corpusflow.session import broadcast_if_small
from corpusflow.sources.parsers import html_text, xml_root_tag
from corpusflow.streaming import events as E

DAY = dt.datetime(2025, 1, 1, 23, 0)


def minutes(n):
    return DAY + dt.timedelta(minutes=n)


def test_cache_entries_live_over_midnight(spark):
    rows = spark.createDataFrame([("k", minutes(30), 1), ("k", minutes(90), 2), ("k", minutes(149), 3), ("k", minutes(151), 4), (None, minutes(0), 5), (None, minutes(1), 6), ("k", None, 7)], "key string, ts timestamp, id int")
    assert {r["id"]: r["hit"] for r in A.cache_hits(rows, "2 hours").collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_hot_key_is_folded_in_order(spark):
    rng = random.Random(3)
    costs = [round(rng.uniform(0, 5), 2) for _ in range(6000)]
    rows = spark.createDataFrame([("hot", "d", i, c, 900.0, "x") for i, c in enumerate(costs)] + [("cold", "d", 0, None, 1.0, "x")], "key string, day string, seq int, cost double, limit double, spent string").repartition(7)
    spent, wanted = 0.0, []
    for cost in costs:
        ok = round(spent + cost, 6) <= 900
        spent = round(spent + cost, 6) if ok else spent
        wanted.append(ok)
    got = {r["seq"]: r["accepted"] for r in A.budget_decisions(rows).collect()}
    assert [got[i] for i in range(6000)] == wanted and len(got) == 6000
    assert A.budget_decisions(rows.where("false")).count() == 0


def test_breaker_opens_and_closes(spark):
    calls = [(0, True), (1, True), (2, True), (3, False), (61, False), (62, True), (63, None), (64, True)]
    rows = spark.createDataFrame([("k", i, minutes(m), f) for i, (m, f) in enumerate(calls)], "key string, seq int, ts timestamp, failed boolean")
    assert [r["state"] for r in A.breaker_states(rows, 3, 3500).orderBy("seq").collect()] == ["closed", "closed", "closed", "open", "half_open", "closed", "closed", "closed"]


def test_places_in_large_and_small_groups(spark):
    rows = spark.createDataFrame([("hot", (i * 37) % 1000, i) for i in range(1000)] + [("b", 5, 1), ("b", 4, 2), (None, 1, 1)], "g string, o int, place_of int").repartition(5)
    got = R.places(rows, "g", ["o", "place_of"]).collect()
    assert all(r["place"] == r["o"] + 1 for r in got if r["g"] == "hot") and len(got) == 1003
    assert sorted((r["o"], r["place"]) for r in got if r["g"] == "b") == [(4, 1), (5, 2)] and [r["place"] for r in got if r["g"] is None] == [1]
    assert R.places(rows.where("false"), "g", ["o"]).count() == 0


def test_semantic_cache_and_embedding_once(spark):
    texts = spark.createDataFrame([("a", "refund of an invoice"), ("b", "invoice an of refund"), ("c", "key rotation"), ("d", "key rotation"), ("e", None), ("f", "")], "id string, text string")
    once = {r["id"]: r["vector"] for r in S.embedded_once(texts).collect()}
    assert set(once) == {"a", "b", "c", "d"} and once["c"] == once["d"] and once["a"] == once["b"] != once["c"]
    vectors = S.hashed_vectors(texts)
    hits = S.semantic_cache_lookup(vectors.where("id in ('a', 'c')"), vectors.where("id in ('b', 'd')"))
    assert {(r["query_id"], r["entry"], r["score"]) for r in hits.collect()} == {("a", "b", 1.0), ("c", "d", 1.0)}
    assert S.semantic_cache_lookup(vectors.where("id = 'a'"), vectors.where("id = 'c'")).count() == 0


def test_top_k_takes_the_smaller_id_of_ties(spark):
    rows = spark.createDataFrame([(str(i), [1.0, float(i % 3)]) for i in range(40)], "id string, vector array<double>")
    got = [r["id"] for r in S.cosine_top_k(rows.where("id = '0'"), rows, 5).orderBy("rank").collect()]
    assert got == sorted((str(i) for i in range(0, 40, 3)))[:5]


def test_entity_words(spark):
    texts = spark.createDataFrame([(1, "Orvane sells API keys"), (2, "the api of orvane and the API"), (3, "nothing"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(1, ["API", "Orvane"]), (2, []), (3, ["API", "API", "Talvex"])], "query_id int, entities array<string>")
    assert [(r["query_id"], r["id"], r["score"]) for r in S.entity_word_search(asked, texts, 5).orderBy("query_id", "rank").collect()] == [(1, 1, 1.0), (1, 2, 1.0), (3, 1, 0.666667), (3, 2, 0.666667)]


def test_chunk_records(spark):
    rows = spark.createDataFrame([("c1", 0, [3.0, 4.0], {"text": "t", "page": "2", "document_id": "old"}, "t", "d1"), (None, 1, [0.0, 0.0], None, "t", None), ("c3", 2, None, None, "t", "d")], "chunk_id string, pos int, vector array<double>, metadata map<string,string>, text string, document_id string")
    got = {r["id"]: r for r in V.chunk_records(rows, "ns").collect()}
    assert set(got) == {"c1", "ns:1"} and got["c1"]["vector"] == [0.6, 0.8] and got["ns:1"]["vector"] == [0.0, 0.0]
    assert got["c1"]["metadata"] == {"page": "2", "document_id": "d1", "chunk_id": "c1"} and got["ns:1"]["metadata"] == {}


def test_merged_entities_and_paths(spark):
    found = spark.createDataFrame([(3, "P", "P:a", "Anna"), (1, "P", "P:a", "anna"), (2, "P", "P:a", "Anna"), (5, "P", "P:b", "Bo")], "doc_id long, type string, entity_id string, name string")
    rows = {r["entity_id"]: r for r in G.merged_entities(found).collect()}
    assert (rows["P:a"]["name"], rows["P:a"]["aliases"], rows["P:a"]["n_docs"], rows["P:a"]["last_doc"]) == ("anna", ["Anna"], 3, 3) and rows["P:b"]["aliases"] == []
    edges = spark.createDataFrame([(a, "p", b) for a, b in ("ab", "bc", "cd", "ac", "da")], "subject_id string, predicate string, object_id string")
    ways = {r["entity_id"]: (r["depth"], "".join(r["path"])) for r in G.shortest_paths(edges, spark.createDataFrame([("a",), ("z",)], "entity_id string")).where("start = 'a'").collect()}
    assert ways == {"a": (0, "a"), "b": (1, "ab"), "c": (1, "ac"), "d": (2, "acd")}


def test_store_keeps_the_last_of_several_batches(spark, tmp_path):
    batches = [[("a", 1, "x"), ("b", 5, "x")], [("a", 3, "y"), ("c", 1, "y")], [("a", 2, "z"), ("b", 5, "z"), (None, 9, "z")], [("d", None, "w")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, created_at int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema("id string, created_at int, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    E.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check", buckets=2)
    assert {(r["id"], r["created_at"], r["v"]) for r in E.read_store(spark, f"{tmp_path}/store").collect()} == {("a", 3, "y"), ("b", 5, "z"), ("c", 1, "y"), ("d", None, "w")}
    assert all(len(v) <= 2 for v in E._versions(spark, f"{tmp_path}/store").values())


def test_values(spark):
    row = spark.createDataFrame([('{"b": 1, "a": "x"}', 0.0, [[1], None, [2, 3]], [{"k": "1"}, {"k": "2", "l": "3"}])], "j string, x double, l array<array<int>>, m array<map<string,string>>")
    got = row.select(U.canonical_json(F.col("j")).alias("c"), U.sigmoid(F.col("x")).alias("s"), U.flattened(F.col("l")).alias("f"), U.merged_outputs(F.col("m")).alias("m"), U.scored(F.col("x"), F.lit(None).cast("double")).alias("v"), slug(F.lit("Café Zürich – Nord")).alias("slug")).first()
    assert (got["c"], got["s"], got["f"], got["m"], got["v"]["score"], got["slug"]) == ('{"a":"x","b":"1"}', 0.5, [1, 2, 3], {"k": "2", "l": "3"}, 0.0, "cafe_zurich_nord")
    years = spark.range(1).select(decompose(F.lit("How did the revenue change between 2022 and 2024?")).alias("p")).first()["p"]
    assert len(years) == 3 and years[-1] == "What is the difference between 2022 and 2024?"


def test_pages_and_sections(spark):
    page = b"<html><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Hi</h1><p title='>'>One <b>two</b></p><script>if (a<b) x('</p>')</script><noscript>no</noscript><!-- <p>no</p> --><div>End</div></body></html>"
    assert html_text(page) == ("Hi\nOne two\nEnd\n", "A & B") and html_text(b"no markup") == ("no markup", None) and html_text(b"") == ("", None)
    assert by_structure("intro\n# A\nbody\n#no\n## B\n", 50) == [("intro", None, 0), ("# A\nbody\n#no", "A", 1), ("## B", "B", 2)]
    tags = spark.createDataFrame([(bytearray(b'<a:doc xmlns:a="u"><x/></a:doc>'),), (bytearray(b"broken"),), (None,)], "c binary").select(xml_root_tag("c").alias("t")).collect()
    assert [r["t"] for r in tags] == ["doc", None, None]


def test_prompts_and_dates(spark):
    said = spark.range(1).select(build_prompt(F.lit("q?"), F.lit("c"), custom="{context}|{question}")["user"].alias("a"), build_prompt(F.lit("q?"), F.lit(""), reason=True, answer_format="JSON")["user"].alias("b")).first()
    assert said["a"] == "c|q?" and said["b"].startswith("Context:\n(no context retrieved)\n\nQuestion: q?\n\nThink through") and said["b"].endswith("Answer format: JSON")
    hits = spark.createDataFrame([(1, "a", 1, 0.9, "s", "2024-05-01"), (1, "b", 2, 0.8, "s", "bad"), (1, "c", 3, 0.7, "s", "1800000000"), (1, "d", 4, 0.6, "s", None)], "query_id int, id string, rank int, score double, source string, date string")
    assert [r["id"] for r in organize(hits, "chronological").orderBy("order").collect()] == ["c", "a", "b", "d"]


def test_wide_rows_are_not_broadcast(spark):
    narrow, wide = spark.range(100).selectExpr("id"), spark.range(100).selectExpr("id", "repeat('x', 1000000) as t", "array(id) as a")
    plan = lambda d: spark.range(1000).join(broadcast_if_small(d), "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(narrow) and "broadcast" not in plan(wide)


def test_mmr_against_picking_by_hand(spark):
    rng = np.random.default_rng(4)
    vectors = {f"d{i}": (lambda v: v / np.linalg.norm(v))(rng.standard_normal(6)) for i in range(9)}
    asked = (lambda v: v / np.linalg.norm(v))(rng.standard_normal(6))
    hits = spark.createDataFrame([("q", i, n + 1, 1.0, "clash") for n, i in enumerate(vectors)], "query_id string, id string, rank int, score double, vector_of string")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id string, vector array<double>")
    picked, left = [], list(vectors)
    while left:
        worth = {i: 0.5 * vectors[i] @ asked - 0.5 * max((vectors[i] @ vectors[p] for p in picked), default=0.0) for i in left}
        best = max(left, key=lambda i: (round(worth[i], 9), -int(i[1:])))
        picked.append(best)
        left.remove(best)
    out = K.mmr(hits, rows, spark.createDataFrame([("q", asked.tolist())], "id string, vector array<double>")).orderBy("mmr_rank").collect()
    assert [r["id"] for r in out] == picked


def test_relations_of_each_text(spark):
    texts = spark.createDataFrame([(1, "Anna Berg works at Orvane Ltd. Talvex Inc acquired Orvane Ltd."), (2, "Anna Berg works for Orvane Ltd."), (3, "Nobody works here."), (4, None)], "id long, text string")
    known = texts.where("text is not null")
    found = {(r["subject_id"], r["predicate"], r["object_id"]): r["n_docs"] for r in G.relations(known, G.mentions(known)).collect()}
    assert found == {("PERSON:anna_berg", "works_at", "ORGANIZATION:orvane_ltd"): 2, ("ORGANIZATION:talvex_inc", "acquired", "ORGANIZATION:orvane_ltd"): 1}


def test_weeks_are_utc_in_any_session(spark):
    rows = spark.createDataFrame([("2025-10-06T00:30:00Z",), ("2025-10-05T23:30:00Z",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert [r["w"] for r in rows.select(week_of(F.col("t")).alias("w")).collect()] == ["2025-10-06", "2025-09-29", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
