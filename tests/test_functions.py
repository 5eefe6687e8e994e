"""Text expressions, conditions, chunking and parsing on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.conditions import classified, condition, first_case
from corpusflow.functions.formats import canonical_format, detect_format
from corpusflow.operators import chunking as H
from corpusflow.sources import parsers as P


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(float(v) if isinstance(v, (int, float)) else v for v in values.values()) or ("",)], schema).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("query", "intent"), [("", "empty"), ("How is data encrypted?", "question"), ("is it on", "question"), ("list all invoices", "command"), ("aes encryption keys", "keyword"), ("  the form? ", "question")])
def test_intent(spark, query, intent):
    assert one(spark, X.detect_intent(F.col("q")), q=query) == intent


def test_process_query(spark):
    p = one(spark, X.process_query(F.col("q"), {"aes": ["rijndael", "cipher"]}), q="Show  AES details from 2024-01-01 for 30 days")
    assert p["normalized"] == "Show AES details from 2024-01-01 for 30 days" and p["intent"] == "command"
    assert p["entities"]["capitalized"] == ["Show", "AES"] and p["entities"]["numbers"] == ["2024", "01", "01", "30"] and p["entities"]["dates"] == ["2024-01-01"]
    assert p["keywords"] == ["show", "aes", "details", "from", "2024", "01", "01", "30", "days"] and p["expansion"] == ["rijndael", "cipher"]


@pytest.mark.parametrize(
    ("question", "parts"),
    [
        ("How did budget change from 2022 to 2023?", ["What was budget change from  to in 2022?", "What was budget change from  to in 2023?", "What is the difference between 2022 and 2023?"]),
        ("Who? Why?", ["Who?", "Why?"]), ("What is X and Y?", ["What is X?", "Y?"]), ("Tell me", ["Tell me?"]),
    ],
)
def test_decompose(spark, question, parts):
    assert one(spark, X.decompose(F.col("q")), q=question) == parts


def test_classes_and_complexity(spark):
    assert one(spark, X.classify_query(F.col("q")), q="fix the null error in get_user()") == "technical"
    assert one(spark, X.classify_query(F.col("q")), q="compare plans") == "analytical"
    assert one(spark, X.classify_query(F.col("q")), q="invoices") == "general"
    c = one(spark, X.complexity(F.col("q")), q="Why did growth change since 2020?")
    assert (c["level"], c["signals"], c["recommended_chunks"]) == ("complex", ["temporal", "causal"], 10)


def test_cleaning_and_titles(spark):
    assert one(spark, X.clean_text(F.col("t")), t="a\r\nb  c \n\n\n\nde\u0301 ") == "a\nb c\n\nd\u00e9"
    assert one(spark, X.derive_title(F.col("t")), t="\n  ## The title \nrest") == "The title"
    assert one(spark, X.derive_title(F.col("t")), t=" \n ") is None
    assert one(spark, X.noise_ratio(F.col("t")), t="") == 1.0 and one(spark, X.noise_ratio(F.col("t")), t="ab$") == pytest.approx(1 / 3)


def test_quality(spark):
    q = one(spark, X.assess_quality(F.col("t"), F.col("l")), t="too short", l="en")
    assert (q["score"], q["action"], q["flags"]) == (0.5, "warn", ["too_short"])
    assert one(spark, X.assess_quality(F.col("t"), F.col("l")), t=None, l=None)["action"] == "reject"


def test_formats(spark):
    assert one(spark, canonical_format(F.col("f")), f=".HTM") == "html" and one(spark, canonical_format(F.col("f")), f=None) == "text"
    assert one(spark, detect_format(F.col("f"), F.col("e")), f="a.b.PDF", e=None) == "pdf" and one(spark, detect_format(F.col("f"), F.col("e")), f="x.bin", e="MD") == "md"


@pytest.mark.parametrize(
    ("spec", "holds"),
    [
        (None, True), ({"op": "==", "left": "$.n", "right": None}, True), ({"op": "!=", "left": "$.n", "right": "a"}, True), ({"op": ">", "left": "$.n", "right": 1}, False), ({"op": "<=", "left": "$.x", "right": 2}, True),
        ({"op": "contains", "left": "$.s", "right": "bc"}, True), ({"op": "startswith", "left": "$.n", "right": "a"}, False), ({"op": "endswith", "left": "$.s", "right": "d"}, True), ({"op": "regex", "left": "$.s", "right": "^a.c"}, True),
        ({"op": "in", "left": "$.s", "right": ["x", "abcd"]}, True), ({"op": "in", "left": "bc", "right": "$.s"}, True), ({"op": "length_gt", "left": "$.s", "right": 3}, True), ({"op": "length_eq", "left": "$.n", "right": 0}, True),
        ({"op": "and", "conditions": [{"op": "not", "condition": {"op": "==", "left": "$.x", "right": 3}}, {"op": "or", "conditions": []}]}, False), ({"op": "contains_item", "left": ["a", "b"], "right": "b"}, True),
    ],
)
def test_conditions(spark, spec, holds):
    assert one(spark, condition(spec), s="abcd", x=2.0, n=None) is holds


def test_routes(spark):
    big = {"op": ">", "left": "$.x", "right": 5}
    assert one(spark, first_case([(big, "big")], "small"), x=7.0) == "big"
    assert one(spark, classified([(big, "big", None)], {"big": 0.8}), x=7.0)["confidence"] == 0.8
    assert one(spark, classified([(big, "big", None)], {}), x=1.0)["category"] == "unknown"
    with pytest.raises(ValueError, match="unknown operator"):
        condition({"op": "like"})


def test_chunkers():
    assert H.recursive("aa\n\nbb\n\n" + "c" * 7, 5) == ["aa", "bb", "ccccc", "cc"] and H.recursive("aa\n\nbb", 6) == ["aa\n\nbb"]
    assert H.by_sentence("One. Two. Three is long.", 10) == ["One. Two.", "Three is l", "ong."]
    assert H.by_structure("intro\n# A\nx\n## B\ny", 50) == [("intro", None, 0), ("# A\nx", "A", 1), ("## B\ny", "B", 2)]
    assert [p for p, _, _ in H.by_declaration("import x\ndef a():\n  1\nclass B:\n  2", 50)] == ["import x", "def a():\n  1", "class B:\n  2"]
    assert H.by_declaration("  ", 10) == []


def test_chunk_documents(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, text string")
    rows = H.chunk_documents(docs, "fixed", 4, 1).orderBy("chunk_index").collect()
    assert [(r["text"], r["start_char"], r["end_char"], r["position"]) for r in rows] == [("abcd", 0, 4, "first"), ("defg", 3, 7, "middle"), ("ghij", 6, 10, "last")]
    for name in ("recursive", "semantic", "structure", "code"):
        (r,) = H.chunk_documents(docs, name, 40).collect()
        assert (r["chunk_id"], r["text"], r["position"], r["token_estimate"]) == ("1::0", "abcdefghij", "only", 2)


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_parsers(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = zipped(**{"word__document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = zipped(**{"xl__workbook.xml": '<workbook><sheets><sheet name="S1"/></sheets></workbook>', "xl__sharedStrings.xml": "<sst><si><t>x</t></si></sst>", "xl__worksheets__sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'})
    pptx = zipped(**{"ppt__slides__slide1.xml": '<sld xmlns:a="u"><a:p><a:r><a:t>One</a:t></a:r></a:p></sld>'})
    rows = [("t", b"a\xffb", "txt"), ("h", b"<head><title>T</title><style>x</style></head><p>one</p><br>two<p>three</p>", "htm"), ("j", b'{"a": {"b": 1}, "c": [2, {"d": null}]}', "json"), ("x", b"<r>a<b>c</b>d</r>", "xml"), ("w", docx, "docx"), ("s", xlsx, ".XLSX"), ("p", pptx, "pptx"), ("i", b"\x89PNG", "png"), ("broken", b"{", "json"), ("null", None, "html")]
    out = {r["id"]: r for r in P.parse_files(spark.createDataFrame(rows, "id string, content binary, format string")).collect()}
    assert out["t"]["text"] == "a\ufffdb" and (out["h"]["text"], out["h"]["title"]) == ("one\ntwothree\n", "T") and out["j"]["text"] == "a.b: 1\nc.2\nc.d: None"
    assert out["x"]["text"] == "a\nc\nd" and out["w"]["text"] == "Hello\na\tb" and out["s"]["text"] == "### Sheet: S1\nx\t5" and out["p"]["text"] == "### Slide 1\nOne"
    assert out["i"]["quality_flag"] == "ocr_unavailable" and out["broken"]["text"] is None and "JSONDecodeError" in out["broken"]["error"] and out["null"]["error"] == "no content"


def test_ingest(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nSome  text here that is long enough to be read by everyone in the room.\n")
    (row,) = P.ingest(P.read_files(spark, str(tmp_path))).collect()
    assert row["title"] == "Title" and row["format"] == "markdown" and len(row["document_id"]) == 16 and "Some text" in row["text"] and row["quality"]["action"] == "ok"
