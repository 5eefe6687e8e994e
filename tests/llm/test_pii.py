"""Personal information: candidates, weak supervision and placeholders."""

from collections import Counter

import pytest

from corpusflow.llm.pii import candidates, estimate_reliabilities, fit, free_texts, mentions, redacted, with_learnt_context


def likely(text):
    """Kinds of the candidates whose votes add up to more than 0, as a stand-in for the fitted classifier."""
    return sorted(c[0] for c in candidates(text) if c[3] + c[4] + c[5] > 0)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Send it to anna.b+x@mail.test, thanks.", ["email"]), ("reach me at ursula dot quenby at inbox dot invalid.", ["email"]), ("an x.y (at) mail.test. Danach", ["email"]), ("The package core@6.45.9 is pinned.", []), ("Use @mention here.", []),
        ("Please call (555) 555-0132 after lunch.", ["phone"]), ("Vous pouvez me joindre au +33 (0)1.99.00.85.52.", ["phone"]), ("Bitte rufen Sie 030 23125 508 an.", ["phone"]), ("ring me on 555 555 0126 ext. 18", ["phone"]), ("joindre au 01\u00a099\u00a000\u00a094\u00a088.", ["phone"]),
        ("My social security number is 981 32 1212, do you need it?", ["identity_number"]), ("Mi DNI es 00471879-K.", ["identity_number"]), ("Mon numéro de sécurité sociale : 3 69 13 99 234 800 32.", ["identity_number"]), ("Passport no. Z38132304 was scanned twice.", ["identity_number"]),
        ("Order 867561591 was paid in full.", []), ("See ticket 1501-38-7781 for details.", []), ("Check sum 5146 3868 8714 8842 is wrong.", []), ("The trace id ends with 11276832.", []), ("The build 2025.48.2041 fixed it.", []), ("Lane 7 of the sorting hub is closed.", []), ("It was 2025-08-11.", []),
        ("I moved to 857 Tannery Road, Port Ellsen last month.", ["street_address"]), ("Le colis est pour vous, 96 impasse des Merles.", ["street_address"]), ("Das Büro ist Birkenallee 47, 00521 Bad Rehberg.", ["street_address"]), ("la oficina de Calle Olmeda, 43 está cerrada.", ["street_address"]),
        ("Ship-to: 9a brindle court / bill-to: Flat 7, 14 Brindle Court", ["street_address"] * 2),
    ],
)
def test_candidates(text, kinds):
    assert likely(text) == kinds


def test_name_candidates():
    names = lambda text: [text[c[1] : c[2]] for c in candidates(text) if c[0] == "name" and c[5] > 0]
    assert names("Ask C. Nethercroft about this.") == ["C. Nethercroft"]
    assert names("Laut Anselm B. Ostrand ist das Büro zu.") == ["Anselm B. Ostrand"]
    assert names("We reimbursed Mr. Tassin and Wanda Pellisard for the trip.") == ["Mr. Tassin", "Wanda Pellisard"]
    assert names("Contact: oskar sondergal, +1 555 555 0190") == ["oskar sondergal"]
    assert names("Brackwell Holdings Ltd renewed the contract.") == []


def test_capitals_hide_only_their_own_lines():
    names = lambda text: [text[c[1] : c[2]] for c in candidates(text) if c[0] == "name"]
    banner = "ALL STAFF ARE ASKED TO READ THIS NOTICE BEFORE THE NEXT SHIFT.\n" * 8
    prose = "Later that day Anna Berg and Omar Falk closed the case. " * 3
    assert names(banner + prose) == names(prose) == ["Anna Berg", "Omar Falk"] * 3
    assert names(prose * 4 + "\n" + banner + prose) == ["Anna Berg", "Omar Falk"] * 15
    assert names(prose + "\nANNA BERG\n" + prose) == [*["Anna Berg", "Omar Falk"] * 3, "ANNA BERG", *["Anna Berg", "Omar Falk"] * 3]
    assert names("PLEASE CALL ANNA BERG") == []


def test_estimate_tells_labelers_apart():
    counts = {(1, 1, 1): 500, (1, 0, 1): 300, (1, -1, -1): 250, (-1, -1, -1): 900, (-1, 0, 0): 700, (1, 0, 0): 40}
    p = estimate_reliabilities(counts.items())
    assert p[1, 1, 1] > 0.99 and p[1, 0, 1] > 0.9 and p[1, -1, -1] < 0.1 and p[-1, 0, 0] < 0.01
    assert estimate_reliabilities([]) == {}


def corpus(spark):
    people = ["Anna Berg", "Omar Falk", "Lena Voss", "Ivo Sand"]
    logs = []
    for i in range(240):
        p, mail = people[i % 4], f"{people[i % 4].split()[0].lower()}{i}@mail.test"
        said = [f"My name is {p} and you can reach me at {mail}.", f"Please call +1 555 555 0{100 + i} after lunch and ask for {p}.", f"Order {867000000 + i * 37} was paid in full.", f"My social security number is 9{10 + i % 80}-{20 + i % 60}-{1000 + i}, do you need it?", f"I moved to {i + 1} Tannery Road, Port Ellsen last month.", "How do I split a large upload?"][i % 6]
        logs.append((f"q{i}", said, "x"))
    logs += [("q0", logs[0][1], "x"), ("null", None, "x"), ("empty", "", "x"), (None, "My name is Anna Berg.", "x")]
    q = spark.createDataFrame(logs, "id string, question string, kind string")
    f = spark.createDataFrame([("f1", "anna@mail.test wrote. Ask Omar Falk about this. Ask Omar Falk about this.", "x")], "id string, comment string, text string")
    d = spark.createDataFrame([(1, "word " * 20_000 + "Send it to anna@mail.test now.", "x")], "doc_id long, text string, start string")
    return free_texts(q, f, d)


def test_mentions_and_placeholders(spark):
    texts = corpus(spark)
    found = mentions(texts)
    rows = found.collect()
    kinds = Counter(r["kind"] for r in rows if r["table_name"] == "query_logs")
    assert kinds == {"name": 80, "email": 40, "phone": 40, "identity_number": 40, "street_address": 40}
    assert sorted((r["kind"], r["occurrence"]) for r in rows if r["row_id"] == "f1") == [("email", 1), ("name", 1), ("name", 2)]
    assert [(r["kind"], r["start"]) for r in rows if r["table_name"] == "documents"] == [("email", 100_011)]
    clean = {r["row_id"]: r["text"] for r in redacted(texts, found).where("table_name = 'query_logs'").collect()}
    assert clean["q0"] == "My name is [NAME] and you can reach me at [EMAIL]." and clean["q2"].startswith("Order 867") and clean["empty"] == ""


def test_rare_kind_is_fitted(spark):
    columns = "kind string, form int, gazetteer int, context int, mask int, before int, after int"
    rows = [("name", 1, 0, 1, i % 128, i % 100, i % 90) for i in range(600)] + [("email", 1, 1, 1, 1, 2, 3)] * 50 + [("phone", 1, 0, 1, 4, 5, 6)]
    assert set(fit(spark.createDataFrame(rows, columns), fit_rows=20)) == {"name", "email", "phone"}


def test_nothing_to_find(spark):
    texts = spark.createDataFrame([], "table_name string, row_id string, text string")
    assert mentions(texts).count() == 0
    assert mentions(spark.createDataFrame([("t", "1", "no one here")], texts.schema)).count() == 0


def test_context_is_learnt_from_sure_mentions(spark):
    sure = [("t", f"{i}", "name", 0, 9, 1, 1, 0, 1, 2, 3, "signatory ,", "") for i in range(8)]
    odd = [("t", "x", "name", 0, 9, 0, 0, 0, 1, 2, 3, "signatory ,", "tomorrow morning"), ("t", "y", "name", 0, 9, 0, -1, 0, 1, 2, 3, "the red", ""), ("t", "z", "name", 0, 9, 1, 1, -1, 1, 2, 3, "signatory ,", ""), ("t", "w", "phone", 0, 9, 0, 0, 0, 1, 2, 3, "signatory ,", "")]
    schema = "table_name string, row_id string, kind string, start int, end int, form int, gazetteer int, context int, mask int, before int, after int, left string, right string"
    out = {(r["row_id"], r["kind"]): r["context"] for r in with_learnt_context(spark.createDataFrame(sure + odd, schema)).collect()}
    assert out["x", "name"] == 1 and out["y", "name"] == 0 and out["z", "name"] == -1 and out["w", "phone"] == 0 and len(out) == 12


def test_names_after_a_heading_in_capitals():
    text = "QUARTERLY REPORT OF THE TEAM ON ALL THINGS THAT WERE DONE. " * 9 + "\nThe case was opened by Anna Miller. Later on Peter Brown closed it."
    assert [text[c[1] : c[2]] for c in candidates(text) if c[0] == "name"] == ["Anna Miller", "Peter Brown"]
