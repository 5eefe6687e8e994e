"""Defects of answers, one by one and in a table."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusflow.llm.pairs import broken_pairs, defect_of, left_open, tiles

Q = "How do I reset the export schedule?"
GOOD = "Open the billing tab, save the form, and wait for the notice."


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty"), (Q, " \n​", "empty"), (Q, "N/A", "empty"), (Q, "...", "empty"), (Q, '""', "empty"), (Q, "none", "empty"), ("How many approvals are needed?", "None.", None), ("What does it cost?", "Nothing", None),
        (Q, GOOD, None), (Q, "Sorry for the confusion in the guide: to reset it, open the tab.", None), (Q, "64", None), (Q, "Two approvals", None), (None, GOOD, None), (Q, Q + " " + GOOD, None),
        (Q, GOOD + " The audit trail records the", "truncated"), (Q, "Yes, members may do so:\n1. open it\n2.", "truncated"), (Q, "Yes:\n1. open it\n2. save it", None), (Q, "It says (as agreed.", "truncated"), (Q, 'Use this:\n```\n{"a": [1', "truncated"),
        (Q, "See:\n\n| a | b |\n|---|---|\n| 1 |", "truncated"), (Q, "See:\n\n| a | b |\n|---|---|\n| 1 | 2 |", None), (Q, "It is <b>here.", "truncated"), (Q, GOOD + " [3]", None), (Q, "Sie sagte „komm“.", None),
        (Q, "I'm sorry, but I can't help with that. Is there anything else you would like to ask?", "refusal"), (Q, "Dazu darf ich keine Auskunft geben.", "refusal"), (Q, "I don't know your role, so here is the general way. " + GOOD, None),
        (Q, "You cannot reset it while an import is running, so wait and then save the form.", None), (Q, "Je ne connais pas la réponse.", "refusal"), (Q, "No puedo responder a esta pregunta.", "refusal"), (Q, "I do not know the answer. [2]", "refusal"),
        (Q, Q, "copy"), (Q, "how do i reset the export schedule", "copy"), (Q, "You asked: " + Q, "copy"), (Q, f"{Q} {Q}", "copy"), (Q, "To reset the export schedule, open the tab and save the form.", None),
        (Q, "Abra la página de ajustes, elija una fecha y espere el aviso.", "wrong_language"), ("Please answer in Spanish: " + Q, "Abra la página de ajustes, elija una fecha y espere el aviso.", None), (Q, "Откройте вкладку и сохраните форму.", "wrong_language"),
    ],
)
def test_defect(question, answer, defect):
    assert defect_of(question, answer) == defect


def test_pushdown_parser():
    assert left_open("a (b [c]") and left_open("« a") and left_open("```x") and not left_open("1) a (b) ```(```")
    assert not left_open("<br> and <i>x</i>") and left_open("<i>x")


def test_very_long_texts():
    assert defect_of(Q, "The form is saved. " * 5000) is None
    assert defect_of("word " * 5000, "word " * 5000) == "copy"


def test_tiles_cover_whole_runs():
    assert tiles("a b c d".split(), "x a b c y".split(), 3) == [False, True, True, True, False]
    assert tiles("a b c".split(), "a b c a b c".split(), 3) == [True] * 6


def test_table(spark):
    rows = [("1", Q, None, 1), ("1", Q, None, 2), ("2", Q, GOOD, 1), ("3", None, "Откройте (", 1), (None, Q, None, 1)]
    frame = spark.createDataFrame(rows, "id string, question string, answer string, defect int")
    assert sorted(map(tuple, broken_pairs(frame).collect())) == [("1", "empty"), ("3", "truncated")]
    assert broken_pairs(frame.where("false")).count() == 0


def test_placeholders_whatever_is_around_them():
    for answer in ("N/A", " " * 200 + "N/A", "N/A" + "\n" * 100, "​" * 90 + "n/a", "  **none**  "):
        assert defect_of("What is the limit?", answer) == "empty"
    assert defect_of("What is the limit?", "None of the plans has one.") is None


def test_short_answers_are_truncated_where_their_last_word_leads_on():
    assert defect_of("Where is it?", "It is stored in the") == "truncated"
    assert defect_of("Wo liegt es?", "Im Ordner für die") == "truncated"
    assert defect_of("How many?", "Two approvals") is None


def test_refusals_by_grammar_in_words_of_other_texts():
    declined = [
        "I won't discuss this.", "I'd rather not say.", "We are unable to comment.", "I have been instructed to avoid political subjects.", "That is beyond my remit, sorry.",
        "Dazu kann ich leider nichts sagen.", "Ich möchte mich dazu nicht äußern.", "Das weiß ich leider nicht.", "Je préfère ne pas répondre.", "Je n'ai aucune information à ce sujet.",
        "Prefiero no opinar sobre eso.", "No tengo información sobre ese tema.", "Sorry, I couldn't find anything about that.",
    ]
    told = ["We do not store card numbers.", "You cannot share reports with guests.", "No, we do not give refunds after 30 days.", "Nothing in the archive covers this topic.", "I can't answer this. The limit is 5 GB.", "Nein, das Limit gilt nicht für Gäste."]
    assert [a for a in declined if defect_of("What is that?", a) not in ("refusal", "wrong_language")] == []
    assert [a for a in told if defect_of("What is that?", a) == "refusal"] == []


def test_tiling_takes_long_repetitions():
    began = time.perf_counter()
    assert defect_of(" ".join(["yes"] * 5000), " ".join(["yes"] * 5001)) == "copy"
    assert sum(tiles(["a", "b"] * 3000, ["b", "a"] * 3000, 3)) == 5999
    assert time.perf_counter() - began < 2


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=14))
def test_tiling_covers_what_trying_all_runs_covers(question, answer):
    runs = {(n, i) for i in range(len(answer)) for n in range(2, len(answer) - i + 1) if any(question[j : j + n] == answer[i : i + n] for j in range(len(question)))}
    covered = [False] * len(answer)
    for n, i in sorted(runs, key=lambda r: (-r[0], r[1])):
        if not any(covered[i : i + n]):
            covered[i : i + n] = [True] * n
    assert tiles(question, answer, 2) == covered
