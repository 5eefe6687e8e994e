"""Parsing binary files into text: built-in expressions for plain formats, small helpers on each file for the rest.

``parse_files`` takes (id, content, format) as Spark's ``binaryFile`` source gives it and keeps one row a file; a file
that can't be parsed has a null text and its error, so that one broken file doesn't end a job.
"""

from __future__ import annotations

import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusflow.functions.formats import canonical_format
from corpusflow.functions.keys import token_estimate
from corpusflow.functions.text import assess_quality, clean_text, derive_title, words

# Elements whose end is a line's end, and those whose content isn't text.
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section".split())
DROPPED = frozenset("script style head noscript".split())
# What markup is made of: comments and declarations, elements whose content is raw, and tags with their name.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>script|style|noscript)\b.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S | re.I)


def _decoded(content: bytes) -> str:
    return content.decode("utf-8", errors="replace")


def html_text(content: bytes) -> tuple[str, str | None]:
    """What a page shows, a line for each block, and its title.

    Markup is cut out by one pattern; a stack of the open elements that aren't shown tells where a text goes.
    """
    page, at = _decoded(content), 0
    unseen: list[str] = []
    shown: list[str] = []
    title: list[str] = []
    for mark in [*MARKUP.finditer(page), None]:
        said = html.unescape(page[at : mark.start() if mark else len(page)])
        if said.strip():
            (title if "title" in unseen else [] if unseen else shown).append(said)
        if mark is None:
            break
        at, name = mark.end(), (mark["name"] or "").lower()
        if not mark["end"]:
            unseen += [name] if name in DROPPED or name == "title" else []
        elif name in unseen:
            del unseen[len(unseen) - 1 - unseen[::-1].index(name)]
        elif name in BLOCKS:
            shown.append("\n")
    return "".join(shown), "".join(t.strip() for t in title) or None


def json_text(content: bytes) -> tuple[str, str | None]:
    """A line for each value, led by its path; items of a list share the list's path."""
    lines: list[str] = []
    stack: list[tuple[str, object]] = [("", json.loads(_decoded(content)))]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [(path + k + ("." if isinstance(v, (dict, list)) else ": "), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(path, v) for v in reversed(node)]
        else:
            lines.append(f"{path}{node}")
    return "\n".join(lines), None


def xml_text(content: bytes) -> tuple[str, str | None]:
    return "\n".join(t.strip() for t in ET.fromstring(content).itertext() if t.strip()), None


@F.pandas_udf(StringType())
def xml_root_tag(content: pd.Series) -> pd.Series:
    """The name of the outermost element of XML given as bytes; null for null and for what isn't XML."""

    def tag(document: bytes) -> str | None:
        try:
            return _local(next(ET.iterparse(io.BytesIO(document), ("start",)))[1])
        except (ET.ParseError, StopIteration):
            return None

    return content.map(tag, na_action="ignore")


def _members(content: bytes, pattern: str) -> Iterator[tuple[str, ET.Element]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if re.fullmatch(pattern, n)]
        for name in sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            yield name, ET.fromstring(archive.read(name))


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def docx_text(content: bytes) -> tuple[str, str | None]:
    """Paragraphs as lines, then the rows of tables with tabs."""
    said = lambda node: "".join(t.text or "" for t in node.iter() if _local(t) == "t")
    lines: list[str] = []
    for _, root in _members(content, r"word/document\.xml"):
        body = next(n for n in root.iter() if _local(n) == "body")
        lines += [said(n) for n in body if _local(n) == "p"]
        lines += ["\t".join(said(c) for c in row if _local(c) == "tc") for table in body.iter() if _local(table) == "tbl" for row in table if _local(row) == "tr"]
    return "\n".join(line for line in lines if line.strip()), None


def xlsx_text(content: bytes) -> tuple[str, str | None]:
    """A headed section for each sheet, rows with tabs."""
    shared = [["".join(t.text or "" for t in item.iter() if _local(t) == "t") for item in root] for _, root in _members(content, r"xl/sharedStrings\.xml")]
    table = shared[0] if shared else []
    names = [n.get("name") for _, root in _members(content, r"xl/workbook\.xml") for n in root.iter() if _local(n) == "sheet"]
    out: list[str] = []
    for i, (_, root) in enumerate(_members(content, r"xl/worksheets/sheet\d+\.xml")):
        out.append(f"### Sheet: {names[i] if i < len(names) else i + 1}")
        for row in (n for n in root.iter() if _local(n) == "row"):
            cells = []
            for cell in row:
                value = next((v.text or "" for v in cell if _local(v) == "v"), "".join(t.text or "" for t in cell.iter() if _local(t) == "t"))
                cells.append(table[int(value)] if cell.get("t") == "s" and value.isdigit() and int(value) < len(table) else value)
            if any(cells):
                out.append("\t".join(cells))
    return "\n".join(out), None


def pptx_text(content: bytes) -> tuple[str, str | None]:
    """A headed section for each slide, its paragraphs as lines."""
    out: list[str] = []
    for i, (_, root) in enumerate(_members(content, r"ppt/slides/slide\d+\.xml"), 1):
        out.append(f"### Slide {i}")
        out += [line for p in root.iter() if _local(p) == "p" if (line := "".join(t.text or "" for t in p.iter() if _local(t) == "t")).strip()]
    return "\n".join(out), None


def pdf_text(content: bytes) -> tuple[str, str | None]:
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ValueError("pdf files need the pypdf library") from missing
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages), None


PARSERS: dict[str, Callable[[bytes], tuple[str, str | None]]] = {"html": html_text, "json": json_text, "xml": xml_text, "docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "pdf": pdf_text}
#: Formats without text of their own: a stand-in text and the flag that says so.
STUBS = {"image": "ocr_unavailable", "audio": "transcription_unavailable", "video": "transcription_unavailable"}
_PARSED = StructType([StructField("text", StringType()), StructField("title", StringType()), StructField("error", StringType())])


def _parse_one(content: bytes | None, fmt: str) -> dict[str, str | None]:
    if content is None:
        return {"text": None, "title": None, "error": "no content"}
    try:
        text, title = PARSERS[fmt](bytes(content))
        return {"text": text, "title": title, "error": None}
    except Exception as problem:  # noqa: BLE001 - whatever a broken file raises is that file's error
        return {"text": None, "title": None, "error": f"{type(problem).__name__}: {problem}"[:200]}


@F.pandas_udf(_PARSED)
def parsed(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parse_one(c, f) for c, f in zip(content, fmt)], columns=["text", "title", "error"])


def parse_files(files: DataFrame) -> DataFrame:
    """(id, format, text, title, quality_flag, error) of files (id, content, format).

    Plain text and Markdown are decoded by Spark; images, audio and video get a stand-in text and a flag.
    """
    plain = F.col("format").isin("text", "markdown")
    stub = F.when(F.col("format") == "image", STUBS["image"]).when(F.col("format").isin("audio", "video"), STUBS["audio"])
    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("error"))
    known = F.col("format").isin(*PARSERS)
    typed = files.select("id", "content", canonical_format(F.col("format")).alias("format"))
    read = typed.withColumn("p", F.when(known, parsed("content", "format")).otherwise(nothing)).withColumn("quality_flag", stub)
    stand_in = F.concat(F.lit("["), F.col("format"), F.lit(": no text extracted]"))
    text = F.when(plain, F.make_valid_utf8(F.col("content").cast("string"))).when(stub.isNotNull(), stand_in).otherwise(F.col("p.text"))
    return read.select("id", "format", text.alias("text"), F.col("p.title").alias("title"), "quality_flag", F.col("p.error").alias("error"))


def ingest(files: DataFrame, language: Column | None = None) -> DataFrame:
    """Documents of parsed files: document_id (SHA-1 of the content, 16 digits), clean text, title, counts and quality.

    ``files`` has id, content and format. A file without text has quality action reject.
    """
    keyed = files.select("id", F.substring(F.sha1("content"), 1, 16).alias("document_id"), F.length("content").alias("file_size"))
    texts = parse_files(files).withColumn("text", clean_text(F.coalesce("text", F.lit(""))))
    quality = assess_quality(F.col("text"), F.lit("und") if language is None else language, F.col("quality_flag"))
    return texts.join(keyed, "id").select(
        "document_id", "id", "format", "text", F.coalesce("title", derive_title(F.col("text"))).alias("title"), F.length("text").alias("char_count"), F.size(words(F.col("text"))).alias("word_count"),
        token_estimate(F.col("text")).alias("token_estimate"), "file_size", quality.alias("quality"), "error",
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, content, format) of all files below a path; the format is that of the name's extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1)
    return files.select(F.col("path").alias("id"), "content", extension.alias("format"))


@F.pandas_udf(StringType())
def html_to_text(content: pd.Series) -> pd.Series:
    """The text of HTML given as a string; null for null."""
    return content.map(lambda c: html_text(c.encode())[0], na_action="ignore")


@F.pandas_udf(StringType())
def json_to_lines(content: pd.Series) -> pd.Series:
    """A line for each value of JSON given as a string; null for null and for what isn't JSON."""
    return content.map(lambda c: _parse_one(c.encode(), "json")["text"], na_action="ignore")
