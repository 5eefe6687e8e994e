"""Ranking, search, reranking, context, logs, stores, graphs and streams on small inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import analytics as A
from corpusflow.operators import context as C
from corpusflow.operators import graph as G
from corpusflow.operators import ranking as R
from corpusflow.operators import rerank as K
from corpusflow.operators import search as S
from corpusflow.operators import store as V
from corpusflow.streaming import events as E

CORPUS = [(1, "the quarterly profit rose"), (2, "profit and loss of the quarter, profit"), (3, "a cat sat"), (4, ""), (5, "the cat and the profit")]


def docs(spark):
    return spark.createDataFrame(CORPUS, "id long, text string")


def test_bm25_by_hand(spark):
    asked = spark.createDataFrame([(1, ["profit", "profit", "cat"])], "query_id int, terms array<string>")
    toks = [t.replace(",", "").split() for _, t in CORPUS]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)

    def score(d):
        out = 0.0
        for q in ["profit", "profit", "cat"]:
            df, tf = sum(q in t for t in toks), d.count(q)
            out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        return round(out, 6)

    wanted = sorted(((score(t), -i) for (i, _), t in zip(CORPUS, toks) if score(t) > 0), reverse=True)
    found = S.bm25(asked, S.postings(docs(spark)), 10).orderBy("rank").collect()
    assert [(r["score"], -r["id"]) for r in found] == wanted
    assert [tuple(r) for r in S.search_texts(asked, docs(spark), 10).orderBy("rank").collect()] == [tuple(r) for r in found]


def test_bm25_blocks(spark, monkeypatch):
    """Many texts and queries over several blocks: as a ready index has it, and without shuffling every pair."""
    monkeypatch.setattr(S, "TEXTS", 128, raising=False)
    monkeypatch.setattr(S, "ASKED", 50, raising=False)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    said = [(i, " ".join(["all", *rng.choice(words, rng.integers(0, 12))]) if i % 7 else None) for i in range(1500)]
    texts = spark.createDataFrame(said, "id long, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", ["all", *rng.choice(words, 3).tolist(), "absent"]) for i in range(150)] + [("none", ["absent"]), ("empty", [])], "query_id string, terms array<string>")
    wanted = S.bm25(asked, S.postings(texts), 7).select("query_id", "id", "score", "rank").collect()
    spark.sparkContext.setJobGroup("blocks", "blocks")
    found = S.search_texts(asked, texts, 7).select("query_id", "id", "score", "rank").collect()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.clearJobGroup()
    stages = {s for job in tracker.getJobIdsForGroup("blocks") for s in tracker.getJobInfo(job).stageIds}
    assert sorted(map(tuple, found)) == sorted(map(tuple, wanted)) and len(found) == 1050
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 1500 * 150 / 10
    assert S.search_texts(asked, texts.where("false"), 7).count() == 0
    assert S.search_texts(asked.where("false"), texts, 7).count() == 0
    monkeypatch.setattr(S, "TERMS", 5, raising=False)
    assert sorted(map(tuple, S.search_texts(asked, texts, 7).select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, wanted))


def test_entity_words_of_most_texts(spark, monkeypatch):
    """A word that most texts have joins no pairs of queries and texts; shares are those counted one by one."""
    rng = np.random.default_rng(5)
    said = [(i, " ".join(["The", *rng.choice(["rome", "oslo", "cairo", "lima"], i % 4)]) if i % 9 else None) for i in range(1200)]
    texts = spark.createDataFrame(said, "id long, text string").repartition(3)
    named = [(f"q{i}", ["The", *rng.choice(["Rome", "Oslo", "Quito"], i % 5).tolist()]) for i in range(60)] + [("none", []), ("null", None), ("hole", ["Rome", None])]
    asked = spark.createDataFrame(named, "query_id string, entities array<string>")
    wanted = []
    for query, entities in named:
        shares = [(-round(sum(e.lower() in (text or "").lower().split() for e in entities if e) / len(entities), 6), i) for i, text in said] if entities else []
        wanted += [(query, i, -share, n + 1) for n, (share, i) in enumerate(sorted(s for s in shares if s[0])[:5])]
    spark.sparkContext.setJobGroup("words", "words")
    found = S.entity_word_search(asked, texts, 5).select("query_id", "id", "score", "rank").collect()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.clearJobGroup()
    stages = {s for job in tracker.getJobIdsForGroup("words") for s in tracker.getJobInfo(job).stageIds}
    assert sorted(map(tuple, found)) == sorted(wanted) and len(found) == 305
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 1200 * 60 / 10
    monkeypatch.setattr(S, "TERMS", 1, raising=False)
    assert sorted(map(tuple, S.entity_word_search(asked, texts, 5).select("query_id", "id", "score", "rank").collect())) == sorted(wanted)


def test_repeated_blocks(spark, monkeypatch):
    """Blocks whose texts and vectors are the same and whose ids differ follow each other in one task."""
    monkeypatch.setattr(S, "TEXTS", 2)
    monkeypatch.setattr(S, "BLOCK", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        texts = spark.createDataFrame([(i, f"same{' cat' * (i % 2)}") for i in range(8)], "id long, text string").coalesce(1)
        asked = spark.createDataFrame([(1, ["cat"]), (2, ["same"])], "query_id long, terms array<string>")
        assert [r["id"] for r in S.search_texts(asked, texts, 3).where("query_id = 1").orderBy("rank").collect()] == [1, 3, 5]
        vectors = texts.select("id", F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("vector")).coalesce(1)
        found = S.cosine_top_k(vectors.where("id < 3"), vectors, 3).orderBy("query_id", "rank").collect()
        assert [r["id"] for r in found] == ["0", "2", "4", "1", "3", "5", "0", "2", "4"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hashed_vectors_agree(spark):
    sparse = {(r["id"], r["idx"]): r["value"] for r in S.hashed_terms(docs(spark)).collect()}
    for r in S.hashed_vectors(docs(spark)).collect():
        assert np.linalg.norm(r["vector"]) == pytest.approx(1)
        assert all(v == pytest.approx(sparse.get((r["id"], i), 0.0)) for i, v in enumerate(r["vector"]))


def test_cosine_top_k(spark):
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((2100, 6))
    frame = spark.createDataFrame([(f"{i:04d}", r.tolist()) for i, r in enumerate(rows)], "id string, vector array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = S.cosine_top_k(frame.where("id < '0003'"), frame, 4).collect()
    for q in range(3):
        wanted = [f"{i:04d}" for i in np.argsort(-(unit @ unit[q]))[:4]]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == f"{q:04d}"] == wanted
    assert S.cosine_top_k(frame.where("false"), frame, 4).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    rows = S.weighted_rrf(a, b).orderBy("rank").collect()
    assert [(r["id"], r["found_by"]) for r in rows] == [("y", "both"), ("x", "semantic"), ("z", "keyword")] and rows[0]["score"] == round(1 / 62 + 1 / 61, 6)


BRANCHES = [(1, "a", 1, "x", 0.9), (1, "a", 2, "y", None), (1, "b", 1, "y", 0.95), (1, "b", 2, "z", 0.1)]


def test_merging(spark):
    rows = spark.createDataFrame(BRANCHES, "query_id int, branch string, pos int, id string, score double")
    ids = lambda d, by="rank": [r["id"] for r in d.orderBy(by).collect()]
    assert ids(R.concatenate(rows), "order") == ["x", "y", "y", "z"] and ids(R.rrf(rows)) == ["y", "x", "z"] and ids(R.ranking(rows, 2)) == ["y", "x"]
    assert ids(R.weighted(rows, {"b": 0.1})) == ["x", "y", "z", "y"] and R.deduplicate(rows).count() == 3
    assert tuple(R.voting(rows).first()) == (1, "y", 2, 0.5) and R.consensus(rows, threshold=0.6).first()["agreed"] is False


def test_answers(spark):
    rows = spark.createDataFrame([(1, "a", 1, "Rates rose again. We sold more."), (1, "b", 1, "rates rose again! Costs fell slightly."), (2, "a", 1, "I don't know."), (3, "a", 1, "")], "query_id int, branch string, pos int, answer string")
    assert [tuple(r) for r in R.common_ground(rows).collect()] == [(1, "rates rose again")]
    assert {tuple(r) for r in R.differences(rows).where("query_id = 1").collect()} == {(1, "a", "we sold more"), (1, "b", "costs fell slightly")}
    assert R.merged_answer(rows).where("query_id = 1").first()["answer"] == "Rates rose again. We sold more. Costs fell slightly."
    told = {r["query_id"]: (r["source_count"], r["answer"][:11]) for r in R.synthesized(rows).collect()}
    assert told == {1: (2, "Rates rose "), 2: (0, "I could not"), 3: (0, "I could not")}


def test_reranking(spark):
    now = F.lit("2025-03-02 00:00:00").cast("timestamp")
    hits = spark.createDataFrame([(1, 1, 1.0, 1, "profit", "a", dt.datetime(2025, 1, 31)), (1, 2, 0.9, 2, "cat profit", "b", None), (1, 3, 0.8, 3, "dog", "b", dt.datetime(2026, 1, 1))], "query_id int, id int, score double, rank int, text string, source string, date timestamp")
    assert [(r["id"], round(r["score"], 4)) for r in K.recency(hits, "date", now).orderBy("rank").collect()] == [(2, 0.9), (3, 0.8), (1, 0.5)]
    assert [r["id"] for r in K.authority(hits, "source", {"b": 2.0}).orderBy("rank").collect()] == [2, 3, 1]
    asked = spark.createDataFrame([(1, "cat profit")], "query_id int, query string")
    crossed = K.cross_encoder(hits, asked)
    assert [r["id"] for r in crossed.orderBy("rank").collect()] == [2, 1, 3] and crossed.where("id = 2").first()["score"] == 1.0
    assert {r["id"]: r["change"] for r in K.rank_changes(hits, crossed).collect()} == {1: -1, 2: 1, 3: 0}
    assert K.agreement([hits, crossed]).first()["agreement"] == pytest.approx(1 / 3, abs=1e-6)


def test_mmr_prefers_unlike(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.6, 0.8])], "id string, vector array<double>")
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, rank int")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vector array<double>")
    assert [r["id"] for r in K.mmr(hits, vectors, asked, 0.4).orderBy("mmr_rank").collect()] == ["a", "c", "b"]


def test_personalize(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, 1, "our revenue", "wiki", 2025, "pdf"), (1, 2, 0.6, 2, "the contract", "x", None, None)], "query_id int, id int, score double, rank int, text string, source string, date_year int, doc_type string")
    profile = spark.createDataFrame([(1, ["Finance"], ["Legal"], ["WIKI"], ["PDF"])], "query_id int, interests array<string>, disinterests array<string>, authority_sources array<string>, preferred_types array<string>")
    out = {r["id"]: r["score"] for r in K.personalize(hits, profile, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert out == {1: pytest.approx(0.5 + 0.15 + 0.2 + 0.10 + 0.08), 2: pytest.approx(0.2)}


def test_context(spark):
    hits = spark.createDataFrame([(1, i, 1.0 / i, i, "x" * n, s) for i, (n, s) in enumerate([(400, "a"), (4000, "a"), (200, "b"), (0, "b")], 1)], "query_id int, id int, score double, rank int, text string, source string")
    assert [(r["id"], r["included"], r["marker"]) for r in C.within_budget(hits, 160).orderBy("rank").collect()] == [(1, True, "[1]"), (2, False, None), (3, True, "[2]")]
    built = C.build_context(hits, 160).first()
    assert built["token_estimate"] == 150 and built["context"].startswith("[1] (a)\nxxx") and "\n\n[2] (b)\nxx" in built["context"] and built["n_dropped"] == 1
    assert [r["id"] for r in C.organize(hits, "diversity").orderBy("order").collect()] == [1, 3, 2, 4]


def test_budget_and_breaker(spark):
    day = dt.date(2025, 1, 1)
    spend = spark.createDataFrame([("k", day, i, c, 10.0) for i, c in enumerate([9.8, 0.5, 0.2, 0.1])], "key string, day date, seq int, cost double, limit double")
    assert [(r["accepted"], r["spent"]) for r in A.budget_decisions(spend).orderBy("seq").collect()] == [(True, 9.8), (False, 9.8), (True, 10.0), (False, 10.0)]
    t = dt.datetime(2025, 1, 1)
    calls = spark.createDataFrame([("k", day, i, t + dt.timedelta(minutes=m), f) for i, (m, f) in enumerate([(0, True), (1, True), (2, False), (40, False), (90, True), (91, False), (200, False)])], "key string, day date, seq int, ts timestamp, failed boolean")
    assert [r["state"] for r in A.breaker_states(calls, 2, 1800).orderBy("seq").collect()] == ["closed", "closed", "open", "half_open", "closed", "closed", "closed"]


def test_cache_and_prices(spark):
    t = dt.datetime(2025, 1, 1)
    reads = spark.createDataFrame([("k", t + dt.timedelta(minutes=m), m) for m in (0, 50, 61, 100, 130)], "key string, ts timestamp, id int")
    assert [r["hit"] for r in A.cache_hits(reads, "1 hour").orderBy("id").collect()] == [False, True, False, True, False]
    row = spark.range(1).select(A.price(F.lit("gpt-4o"), F.lit(1000), F.lit(200)).alias("p"), A.recommended_model(F.lit(0.004), F.lit(1000), F.lit(200)).alias("m"), A.variant_of(F.lit("t"), F.lit("u"), ["b", "a"]).alias("v")).first()
    import hashlib

    assert row["p"] == 0.008 and row["m"]["model"] == "gemini-1.5-pro" and row["v"] == ["a", "b"][int(hashlib.md5(b"t:u").hexdigest(), 16) % 2]


def test_store(spark):
    t = dt.datetime(2025, 1, 1)
    rows = spark.createDataFrame([("s", "n", "a", t, 1), ("s", "n", "a", t + dt.timedelta(1), 2), ("s", None, "a", t, 3)], "store_name string, namespace string, id string, created_at timestamp, v int")
    last = V.last_write(rows, "created_at")
    assert sorted(r["v"] for r in last.collect()) == [2, 3]
    assert sorted(r["v"] for r in V.upsert(last, last.where("namespace is null").withColumn("v", F.lit(9))).collect()) == [2, 9]
    assert [r["v"] for r in V.delete(last, rows).collect()] == [3]


def test_graph(spark):
    docs_ = spark.createDataFrame([(1, "Sarah Johnson works at Acme Corp. Acme Corp uses Python."), (2, "Nothing here")], "id int, text string")
    found = G.mentions(docs_)
    assert {r["entity_id"] for r in found.collect()} >= {"PERSON:sarah_johnson", "ORGANIZATION:acme_corp", "TECHNOLOGY:python"}
    triples = {(r["subject_id"], r["predicate"], r["object_id"]) for r in G.relations(docs_, found.where("type <> 'PLACE'")).collect()}
    assert triples == {("PERSON:sarah_johnson", "works_at", "ORGANIZATION:acme_corp"), ("ORGANIZATION:acme_corp", "uses", "TECHNOLOGY:python")}
    edges = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "q", "c"), ("c", "p", "d"), ("d", "p", "e"), ("e", "p", "f")], "subject_id string, predicate string, object_id string")
    paths = {r["entity_id"]: r["depth"] for r in G.shortest_paths(edges, spark.createDataFrame([("a",)], "entity_id string")).collect()}
    assert paths == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4}
    assert {r["entity_id"]: r["degree"] for r in G.degrees(edges).collect()}["c"] == 4


def test_upsert_stream_keeps_the_latest(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    schema = "id string, created_at timestamp, v int"
    source, store = tmp_path / "in", tmp_path / "store"
    spark.createDataFrame([("a", t, 1), ("b", t, 1)], schema).coalesce(1).write.parquet(f"{source}/1")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    E.upsert_stream(stream(), str(store), str(tmp_path / "checkpoint"))
    spark.createDataFrame([("a", t + dt.timedelta(1), 2), ("b", t - dt.timedelta(1), 0), ("c", t, 5)], schema).coalesce(1).write.parquet(f"{source}/2")
    E.upsert_stream(stream(), str(store), str(tmp_path / "checkpoint"))
    rows = E.read_store(spark, str(store)).collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [("a", 2), ("b", 1), ("c", 5)]


def test_every_query_is_named_for_its_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
