"""The byte-pair automaton against a tokenizer library, and the token budget."""

import datetime as dt
import random
import time

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm.bpe import WORDS, Counter, Vocabulary, read_ranks, token_counter
from corpusflow.llm.token_budget import token_budget

PATHS = [f"/opt/tokenizers/{n}.tiktoken" for n in ("byte_bpe_50k", "byte_bpe_multi_50k")]


@pytest.fixture(scope="module", params=PATHS)
def pair(request):
    ranks = read_ranks(request.param)
    return Counter(Vocabulary(ranks)), tiktoken.Encoding("t", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def test_random_words(pair):
    count, encoding = pair
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abcdeghilmnoprstuäßéñ的日😀 ") for _ in range(rng.randint(0, 60)))
        assert count(text) == len(encoding.encode_ordinary(text))


def test_long_run(pair):
    count, encoding = pair
    for text in ("a" * 5000, "ab" * 3000, " " * 2000, "x\n" * 1000):
        assert count(text) == len(encoding.encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ranks = read_ranks(PATHS[0])
    global _counter
    if "_counter" not in globals():
        _counter = Counter(Vocabulary(ranks)), tiktoken.Encoding("t", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    count, encoding = _counter
    assert count(text) == len(encoding.encode_ordinary(text))


def test_vocabulary_without_some_bytes():
    ranks = {token: rank for rank, token in enumerate([b"a", b"b", b"ab", b"c", b"abc"])}
    count = Vocabulary(ranks).count
    assert [count(w) for w in (b"ab", b"abc", b"ab?", b"?ab?abc", b"???", b"", b"acb")] == [1, 1, 2, 4, 3, 0, 3]
    began = time.perf_counter()
    assert count(b"?a" * 100_000) == 200_000
    assert time.perf_counter() - began < 2


def test_exact_counts_of_all_chunks(spark):
    """Every chunk of the smallest tables, against the tokenizer library."""
    folder = "/root/testdata/sf0.001"
    encoding = tiktoken.Encoding("t", pat_str=WORDS, mergeable_ranks=read_ranks(PATHS[0]), special_tokens={})
    chunks, documents = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("chunks", "documents"))
    rows = {(r["chunk_id"], r["document_id"]): len(encoding.encode_ordinary(r["text"] or "")) for r in chunks.collect() if r["chunk_id"] and r["document_id"]}
    placed = {r["document_id"] for r in documents.where("source is not null and lang is not null").collect()}
    cube = token_budget(documents, chunks, token_counter(spark, PATHS[0])).where("level = 7").agg({"bpe_tokens": "sum", "n_chunks": "sum"}).first()
    assert cube["sum(bpe_tokens)"] == sum(n for (_, d), n in rows.items() if d in placed)
    assert cube["sum(n_chunks)"] == sum(d in placed for _, d in rows)


def test_budget(spark):
    monday = dt.datetime(2025, 10, 8)
    docs = [("d1", "Help_Center", "en-US", ".MD", monday, 1), ("d2", "help center", "EN", "markdown", monday, 2), ("d3", None, "en", "txt", monday, 3), ("d4", "x", None, "txt", monday, 4)]
    documents = spark.createDataFrame(docs, "document_id string, source string, lang string, format string, ingested_at timestamp, tokens int")
    parts = [("d1::0", "d1", "a" * 40), ("d1::0", "d1", "a" * 40), ("d1::1", "d1", ""), ("d2::0", "d2", None), ("d3::0", "d3", "x" * 99), ("q::0", "q", "x"), (None, "d1", "x"), ("z", None, "x")]
    chunks = spark.createDataFrame([(*p, 7) for p in parts], "chunk_id string, document_id string, text string, token_estimate int")
    cube = token_budget(documents, chunks, token_counter(spark, PATHS[0])).collect()
    finest = [r for r in cube if r["level"] == 0]
    assert [(r["ingest_week"], r["source"], r["lang"], r["format"], r["tokens"], r["n_chunks"]) for r in finest] == [("2025-10-06", "help-center", "en", "markdown", 11, 3)]
    assert finest[0]["bpe_tokens"] == Counter(Vocabulary(read_ranks(PATHS[0])))("a" * 40)
    assert len(cube) == 8 and all(r["tokens"] == 11 for r in cube)
    assert token_budget(documents.where("false"), chunks.where("false"), token_counter(spark, PATHS[0])).count() == 0
