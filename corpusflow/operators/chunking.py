"""Cutting texts into chunks: fixed windows as columns, the others by a small helper on each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusflow.functions.keys import token_estimate

# The separators that a text is cut at, the coarsest first, and what starts a declaration in code.
LADDER = ("\n\n", "\n", ". ", " ")
DECLARATION = re.compile(
    r"^[ \t]*(?:def |async def |class |function |async function |const \w|let \w|var \w|export (?:default )?(?:function|class|const)|func |pub fn |fn |(?:public|private|protected|internal|static)\s+\w|sub |def self\.|#\[|@)", re.M
)
HEADING = re.compile(r"^(#{1,6})[^\S\n]+(.*)$", re.M)
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before; the first to reach the end is the last."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pack(parts: list[str], size: int, join: str) -> list[str]:
    """Neighbouring parts joined as long as they fit."""
    out: list[str] = []
    for part in parts:
        if out and out[-1] and len(out[-1]) + len(join) + len(part) <= size:
            out[-1] += join + part
        else:
            out.append(part)
    return out


def recursive(text: str, size: int, ladder: tuple[str, ...] = LADDER) -> list[str]:
    """Packed at the coarsest separator; pieces still too long are cut at the next one, in the end anywhere."""
    if not ladder:
        return [text[i : i + size] for i in range(0, len(text), size)] or [text]
    out: list[str] = []
    run: list[str] = []
    for part in text.split(ladder[0]):
        if len(part) > size:
            out += [*pack(run, size, ladder[0]), *recursive(part, size, ladder[1:])]
            run = []
        else:
            run.append(part)
    return [piece for piece in [*out, *pack(run, size, ladder[0])] if piece.strip()]


def by_sentence(text: str, size: int) -> list[str]:
    """Packed sentences; a sentence that is too long is cut anywhere, and its rest packed on."""
    out: list[str] = []
    held = ""
    for sentence in filter(str.strip, SENTENCE_GAP.split(text)):
        if held and len(held) + 1 + len(sentence) <= size:
            held = f"{held} {sentence}"
        else:
            out += [held] if held else []
            held = sentence
        cuts = max(0, -(-len(held) // size) - 1)
        out += [held[i * size : (i + 1) * size] for i in range(cuts)]
        held = held[cuts * size :]
    return [*out, held] if held else out


Piece = tuple[str, str | None, int]


def by_structure(text: str, size: int) -> list[Piece]:
    """(piece, heading, level): sections at Markdown headings, the heading's line included; long ones cut on."""
    heads = list(HEADING.finditer(text))
    sections = [text[: heads[0].start() if heads else len(text)], *(text[h.start() : n.start() if n else len(text)] for h, n in zip(heads, [*heads[1:], None]))]
    told = [(None, 0), *((h[2].strip(), len(h[1])) for h in heads)]
    whole = ((section.strip(), *of) for section, of in zip(sections, told))
    return [(piece, heading, level) for body, heading, level in whole if body for piece in ([body] if len(body) <= size else recursive(body, size))]


def by_declaration(text: str, size: int) -> list[Piece]:
    """(piece, None, block): blocks that start at declarations; long ones cut on, their pieces keeping the block's number."""
    starts = [m.start() for m in DECLARATION.finditer(text)]
    if not starts:
        return [(piece, None, i) for i, piece in enumerate(recursive(text, size))] if text.strip() else []
    bounds = [*([0] if starts[0] else []), *starts, len(text)]
    blocks = [b for b in (text[i:j].strip() for i, j in zip(bounds, bounds[1:])) if b]
    return [(piece, None, n) for n, block in enumerate(blocks) for piece in ([block] if len(block) <= size else recursive(block, size))]


STRATEGIES: dict[str, Callable[[str, int], list[Piece]]] = {
    "recursive": lambda t, n: [(p, None, 0) for p in recursive(t, n)],
    "semantic": lambda t, n: [(p, None, 0) for p in by_sentence(t, n)],
    "sentence": lambda t, n: [(p, None, 0) for p in by_sentence(t, n)],
    "structure": by_structure,
    "code": by_declaration,
}
_PIECES = ArrayType(StructType([StructField("text", StringType()), StructField("heading", StringType()), StructField("level", IntegerType()), StructField("start_char", IntegerType())]))


def placed(text: str, pieces: list[Piece]) -> list[dict[str, object]]:
    """Pieces with where they start, looked for from the end of the one before; that end where they aren't found."""
    out, at = [], 0
    for piece, heading, level in pieces:
        found = text.find(piece, at)
        start = found if found >= 0 else at
        at = start + len(piece)
        out.append({"text": piece, "heading": heading, "level": level, "start_char": start})
    return out


def chunk_documents(texts: DataFrame, strategy: str = "recursive", size: int = 400, overlap: int = 0, unit: str = "chars") -> DataFrame:
    """(id, chunk_id, chunk_index, text, start_char, end_char, char_count, token_estimate, heading, level, position) of (id, text).

    Sizes in tokens are four characters each. Position is only, first, middle or last. Null and empty texts have no chunks.
    Overlap only applies to fixed windows.
    """
    chars = max(1, size * (4 if unit == "tokens" else 1))
    if strategy == "fixed":
        step = max(1, chars - overlap)
        each = texts.where(F.length("text") > 0).select("id", fixed_windows(F.col("text"), chars, overlap).alias("w")).select("id", F.size("w").alias("n"), F.posexplode("w").alias("chunk_index", "text"))
        each = each.select("id", "n", "chunk_index", "text", F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), (F.col("chunk_index") * step).alias("start_char"))
    else:
        cut = STRATEGIES[strategy]

        @F.pandas_udf(_PIECES)
        def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for bodies in batches:
                yield pd.Series([placed(b, cut(b, chars)) if isinstance(b, str) else [] for b in bodies])

        each = texts.select("id", pieces.asNondeterministic()("text").alias("ps")).select("id", F.size("ps").alias("n"), F.posexplode("ps").alias("chunk_index", "p")).select("id", "n", "chunk_index", "p.text", "p.heading", "p.level", "p.start_char")
    n = F.col("n")
    position = F.when(n == 1, "only").when(F.col("chunk_index") == 0, "first").when(F.col("chunk_index") == n - 1, "last").otherwise("middle")
    return each.select(
        "id", F.concat(F.col("id").cast("string"), F.lit("::"), "chunk_index").alias("chunk_id"), "chunk_index", "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"),
        F.length("text").alias("char_count"), token_estimate(F.col("text")).alias("token_estimate"), "heading", "level", position.alias("position"),
    )


def chunk_summary(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_chunks, n_chars, avg_chars, min_chars, max_chars, n_tokens)."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum("char_count").alias("n_chars"), F.round(F.avg("char_count"), 6).alias("avg_chars"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"), F.sum("token_estimate").alias("n_tokens"))


def recommended_strategy(filename: Column, text: Column) -> Column:
    """The strategy that a file's name and text suggest."""
    fmt = F.regexp_extract(F.lower(filename), r"\.([^.]+)$", 1)
    head = lambda n: F.substring(text, 1, n)
    coded = F.lit(False)
    for word in ("def ", "class ", "function ", "func "):
        coded = coded | F.contains(head(500), F.lit(word))
    return (
        F.when((fmt == "pptx") | text.contains("### Slide"), "structure").when((fmt == "xlsx") | head(500).contains("\t"), "fixed")
        .when(head(200).contains("#") & text.contains("\n#"), "structure").when(coded, "code").when(F.length(text) < 2000, "semantic").otherwise("recursive")
    )
