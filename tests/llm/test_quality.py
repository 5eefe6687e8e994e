"""Text statistics: chunks against whole texts, and forms."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm.quality import COUNTS, KINDS, count_chunk, split_text, text_statistics

ADDITIVE = [i for i, c in enumerate(COUNTS) if not c.endswith("_chars") or c in ("n_chars", "word_chars")]


def summed(text, size):
    parts = [count_chunk(*piece) for piece in split_text(text, size)]
    return [sum(p[i] for p in parts) for i in ADDITIVE]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab the.\n!\t-é1", max_size=120), st.integers(1, 20))
def test_chunks_keep_what_can_be_kept(text, size):
    assert "".join(p[0] for p in split_text(text, size)) == text
    whole = [count_chunk(text)[i] for i in ADDITIVE]
    parts = summed(text, size)
    assert parts[0] == whole[0] and parts[COUNTS.index("n_symbols")] == whole[COUNTS.index("n_symbols")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "rabbit", "Haus", "x", "12", "."]), max_size=60), st.integers(12, 40), st.randoms())
def test_chunks_add_up_to_the_whole(items, size, rng):
    text = "".join(w + rng.choice([" ", " ", "\n", ". "]) for w in items)
    assert summed(text, size) == [count_chunk(text)[i] for i in ADDITIVE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab the.\n!-é1'", max_size=150), st.integers(20, 40))
def test_every_count_adds_up(text, size):
    assert summed(text, size) == [count_chunk(text)[i] for i in ADDITIVE]


def test_words_without_blanks_and_one_very_long_line():
    for text in ("it's-a-" * 30 + "end", "a-" * 60, "x'" * 60, "the-" * 50):
        assert summed(text, 24) == [count_chunk(text)[i] for i in ADDITIVE]
    began = time.perf_counter()
    assert sum(p[4] for p in split_text("word " * 400_000, 4096)) == len(split_text("word " * 400_000, 4096)) - 1
    assert time.perf_counter() - began < 2


def test_cut_inside_a_word():
    text = "a" * 95 + " the end.\n"
    assert summed(text, 10) == [count_chunk(text)[i] for i in ADDITIVE]


PROSE = "The audit trail records the storage quota after the weekly backup. Nobody should split a large upload without approval. "
LIST = "Scope:\n" + "\n".join(f"- the item {w}" for w in "one two three four five six".split())
TABLE = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(8))
CSV = "\n".join(f'2025-01-0{i},"two words",{i}.50,late' for i in range(1, 9))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE * 3, "prose"), ("# Heading\n\n" + PROSE, "prose"), (PROSE.replace(" ", "\n", 3), "prose"), (PROSE * 4 + LIST, "prose"), (LIST, "list"), ("unused licences\nthe risk score\nrequest a refund\ntwo approvals", "list"),
        (TABLE, "table"), (CSV, "table"), (CSV.replace(",", ";"), "table"), (CSV.replace(",", "\t"), "table"), ("", "junk"), (None, "junk"), ("﻿", "junk"), ("...", "junk"), ("quota quota quota quota quota quota", "junk"),
        ("requests plan plan requests plan requests requests plan plan", "junk"), ("^e !s''I fr: <!s; ib},!I_ c1{*ltd b!{ .lIb l_ ii~l: d`c", "junk"), ("=====\n~~~~~~\n#####", "junk"), ("00000000  fb 70 dc e9 4f a4 2d 84\n00000010  e0 61 52 e1 b0 ab 03 c2", "junk"), ("gitqftowfaw ffflqtyadrdu sketqusdqtophydptaydt qegku", "junk"), ("Encrypted backups", "prose"),
    ],
)
def test_forms(spark, text, kind):
    counts = dict(zip(COUNTS, count_chunk(text or "")))
    most = max(counts[f"{k}_chars"] for k in KINDS)
    assert ("junk" if not most else next(k for k in KINDS if counts[f"{k}_chars"] == most)) == kind


def test_statistics(spark):
    rng = random.Random(1)
    long = " ".join(PROSE.split()[rng.randrange(18)] for _ in range(12_000)) + "."
    rows = [(1, PROSE, "c"), (1, PROSE, "c"), (2, None, ""), (3, "", ""), (4, LIST, ""), (5, "Done.\nNot done", ""), (6, long, ""), (None, "The end.", "")]
    out = {r["doc_id"]: r for r in text_statistics(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert len(out) == 7 and out[1]["kind"] == "prose" and out[2]["kind"] == out[3]["kind"] == "junk" and out[4]["kind"] == "list"
    assert out[2]["n_words"] == 0 and out[2]["mean_word_length"] == 0 and out[5]["punct_line_share"] == 0.5
    assert out[6]["n_words"] == 12_000 and out[6]["n_chars"] == len(long)
    assert text_statistics(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_form_is_that_of_the_whole_text(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice(["the", "of", "and", "rabbit", "garden", "clock", "letter", "river", "lamp", "stone", "window", "paper", "bread", "chair", "field", "horse", "market", "bridge"]) + "." * (i % 9 == 8) for i in range(700)) + ".\n"
    text = passage * (80_000 // len(passage))
    short = passage * (16_000 // len(passage))
    out = {r["doc_id"]: r["kind"] for r in text_statistics(spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")).collect()}
    assert len(text) > 60_000 and out == {1: "junk", 2: "prose"}
