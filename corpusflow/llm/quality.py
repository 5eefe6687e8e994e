"""Text quality statistics per document and whether it is prose, list, table or junk.

Texts above ``CHUNK`` characters are split into chunks, at a line's end if there is one, else at a blank, else anywhere. Each
chunk gives counts that add up: a word or line belongs to the chunk in which it starts, and a chunk carries what its
start and end cut through, so that the sums are those of the whole text. Chunks of one text are spread over tasks and
their counts merged by aggregation with map-side sums; shorter texts are counted where they are read. Forms don't add
up, as repetition, blocks and marked lines are judged over all of a text, so every text's form is told from the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from corpusflow.llm.pairs import FUNCTION
from corpusflow.session import checkpointed

CHUNK = 16_384
KINDS = ("prose", "list", "table", "junk")
COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_punct_lines", "n_common", *(f"{k}_chars" for k in KINDS))

COMMON = frozenset().union(*FUNCTION.values())
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
ITEM = re.compile(r"\s*(?:[-*•+–▪◦‣]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\])\s+(?=\S)")
RULE = re.compile(r"[\s\-=*_~#.+|:]*$")
HEX = re.compile(r"(?:[0-9a-fA-F]{4,}[:\s]+)?(?:[0-9a-fA-F]{2,4}[ :]+){5,}")
ENDS = re.compile(r"[.!?…。！？][\"'”“’»)\]*_]*(?=\s|$)")
GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
QUOTED = re.compile(r'"[^"]*"')
JOINS = ("'", "’", "-")
LONG_RUN = re.compile(r"\S{60,}")
SYMBOL = re.compile(r"[^\w\s]|_")
ODD = re.compile(r"[^\w\s.,;:?!'\"()\-–—/%|€$£&„“”«»¿¡’‘…•@#+]|_")
CELL_MARK = re.compile(r"[.,;|\-:\"]")
LONGEST_COMMON = max(map(len, COMMON)) + 1
SAID = frozenset(w for w in COMMON if len(w) > 1)
UNLIKELY = re.compile(r"q[^u\W]|[bcdfghjklmnpqrstvwxz]{5}|\w{30}")
PUNCT = frozenset(".!?…:;。！？\"'”“’»)")


def split_text(text: str, size: int = CHUNK) -> list[tuple[str, bool, bool, str, bool]]:
    """(chunk, cuts a word at its start, cuts a word at its end, last visible character of the line before it, its line goes on).

    The character is empty where the chunk starts a line, and a blank where its line has nothing visible before it.
    """
    out, at, before = [], 0, ""
    while at < len(text) or not out:
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind("\n", at, end)
            if cut < 0:
                cut = max(text.rfind(" ", at, end), text.rfind("\t", at, end))
            # Without a blank the cut is between words, and in a word only if that is too long to be a common one.
            end = cut + 1 if cut >= at else next((e for e in range(end, max(at, end - LONGEST_COMMON), -1) if not _in_word(text, e)), end)
            # An apostrophe or hyphen in a word goes with what follows it.
            end -= end - 1 > at and text[end - 1] in JOINS and _in_word(text, end - 1)
        out.append((text[at:end], _in_word(text, at), _in_word(text, end), before, end < len(text) and text[end - 1] != "\n"))
        if text[end - 1 : end] == "\n":
            before = ""
        else:
            # What is visible last on the line that goes on; the line may have begun in an earlier chunk.
            line = out[-1][0].rpartition("\n")
            before = line[2].rstrip()[-1:] or (before if not line[1] else "") or " "
        at = max(end, at + 1)
    return out


def _in_word(text: str, at: int) -> bool:
    """Whether a word goes on from before ``at`` to after it."""
    return at > 0 and text[at - 1].isalnum() and (text[at : at + 1].isalnum() or text[at : at + 1] in JOINS and text[at + 1 : at + 2].isalnum())


def _cells(line: str) -> tuple[str, int]:
    """The separator that a line has most likely cells by, and the number of cells."""
    if line.count("|") >= 2 or line.lstrip().startswith("|"):
        return "|", line.strip().strip("|").count("|") + 1
    if "\t" in line.strip():
        return "\t", line.count("\t") + 1
    bare = QUOTED.sub('""', line)
    if bare.count(";") >= 2:
        return ";", bare.count(";") + 1
    if bare.count(",") >= 2:
        return ",", bare.count(",") + 1
    gaps = len(GAPS.findall(line))
    return ("  ", gaps + 1) if gaps else ("", 1)


def _readable(line: str) -> bool:
    """Whether most of what is visible belongs to words, numbers, cells or ordinary punctuation."""
    visible = sum(map(len, line.split()))
    marks = len(SYMBOL.findall(line))
    if not marks:
        return True
    words = visible - marks + len(CELL_MARK.findall(line))
    return words >= 0.6 * visible and len(ODD.findall(line)) <= 0.18 * visible


def _looped(tokens: list[str]) -> bool:
    """Whether words go round in circles: too few different runs of three for their number, or hardly any different words."""
    n = len(tokens)
    if n < 12:
        return n >= 5 and len(set(tokens)) == 1
    return len(set(tokens)) <= max(2, min(12, 0.12 * n)) and n >= 12 or len(set(zip(tokens, tokens[1:], tokens[2:]))) < 0.12 * (n - 2)


def _unsaid(text: str, tokens: list[str]) -> bool:
    """Whether plain words say nothing: no sentence ends, and there is hardly a function word or most can't be words."""
    if ENDS.search(text) or len(tokens) < 2:
        return False
    unlikely = sum(len(t) for t in tokens if UNLIKELY.search(t))
    return len(tokens) >= 5 and sum(t in SAID for t in tokens) < 0.08 * len(tokens) or unlikely > 0.4 * sum(map(len, tokens))


def form_of(text: str, tokens: list[str] | None = None) -> dict[str, int]:
    """Characters of each form in a text, line by line; blank lines and rules count for none. ``tokens``: its words, if at hand."""
    sums = dict.fromkeys(KINDS, 0)
    tokens = WORD.findall(text.lower()) if tokens is None else tokens
    if not text.strip():
        return sums
    lines = text.split("\n")
    sizes = [len(line.strip()) for line in lines]
    if _looped(tokens) or not tokens:
        return sums | {"junk": sum(sizes)}
    cells = [_cells(line) if size else ("", 0) for line, size in zip(lines, sizes)]
    block: list[int] = []
    marked: list[tuple[int, bool]] = []

    def tabular(i: int) -> bool:
        mark, n = cells[i]
        if n < 2:
            return False
        near = [cells[j] for j in (i - 1, i + 1) if 0 <= j < len(lines) and sizes[j]]
        if mark == "|":
            return True
        if mark in "\t":
            return any(m == mark for m, _ in near)
        if mark == "  ":
            return any(m == mark and abs(k - n) <= 2 for m, k in near)
        parts = QUOTED.sub("q", lines[i]).split(mark)
        short = max(len(p.split()) for p in parts) <= 5 and not (lines[i].rstrip()[-1:] in ".!?" and " " in parts[-1].strip())
        tight = sum(p[:1] == " " for p in parts[1:]) <= 0.5 * (len(parts) - 1)
        return short and (tight or n >= 4) and any(m == mark and k == n for m, k in near)

    def flush() -> None:
        """A block of plain lines: prose if sentences end in it often enough, else a list of unmarked items."""
        if not block:
            return
        # A first line that stands apart is a heading and says nothing of the rest.
        body = block[1:] if len(block) > 2 and lines[block[0]].rstrip().endswith(":") else block
        ends = sum(len(ENDS.findall(lines[i])) for i in body)
        widest = max(sizes[i] for i in body)
        joined = "\n".join(lines[i] for i in body)
        if len(body) <= 2 and _unsaid(joined, WORD.findall(joined.lower())) and (len(joined) > 50 or len(block) == len(lines)):
            sums["junk"] += sum(sizes[i] for i in block)
            block.clear()
            return
        plain = len(body) >= 3 and ends < 0.25 * len(body) and widest <= 90 and sum(len(lines[i].split()) for i in body) <= 9 * len(body)
        for i in block:
            sums["list" if plain else "prose"] += sizes[i]
        block.clear()

    for i, line in enumerate(lines):
        size = sizes[i]
        if not size:
            flush()
        elif RULE.match(line) and "|" not in line:
            continue
        elif HEX.match(line.strip()) or not _readable(line):
            flush()
            sums["junk"] += size
        elif LONG_RUN.search(line) and len(line.split()) <= 3 and "://" not in line:
            flush()
            sums["junk"] += size
        elif tabular(i):
            flush()
            sums["table"] += size
        elif ITEM.match(line):
            flush()
            content = line[ITEM.match(line).end() :]
            marked.append((size, bool(ENDS.search(content)) and len(content.split()) > 6))
        elif line.lstrip().startswith("#"):
            flush()
            sums["prose"] += size
        else:
            block.append(i)
    flush()
    # Marked lines are a list unless most of them are sentences.
    sums["prose" if 2 * sum(n for n, whole in marked if whole) > sum(n for n, _ in marked) and 2 * sum(whole for _, whole in marked) > len(marked) else "list"] += sum(n for n, _ in marked)
    return sums


def count_chunk(text: str, cut_start: bool = False, cut_end: bool = False, before: str = "", open_line: bool = False, with_forms: bool = True) -> tuple[int, ...]:
    """The counts in ``COUNTS`` of a chunk; without ``with_forms`` those of forms are 0."""
    found = WORD.findall(text.lower())
    starts_word = cut_start and bool(found)
    # A joint at the start belongs to the word that goes on.
    joint = starts_word and text[0] in JOINS
    ends_word = cut_end and bool(found)
    whole = found[1 if starts_word else 0 : len(found) - ends_word or None]
    whole = whole if not (starts_word and ends_word and len(found) == 1) else []
    lines = text.split("\n")
    closed = lines[:-1] if text.endswith("\n") else lines
    punct = n_lines = 0
    for i, line in enumerate(closed):
        goes_on = i == len(closed) - 1 and open_line
        last = line.rstrip()[-1:] or (before if i == 0 else "")
        if last.strip():
            n_lines += not (i == 0 and before.strip())
            punct += last in PUNCT and not goes_on
    forms = form_of(text, found) if with_forms else dict.fromkeys(KINDS, 0)
    return (
        len(text), len(found) - starts_word, sum(map(len, found)) + joint, len(SYMBOL.findall(text)), n_lines, punct,
        sum(map(COMMON.__contains__, whole)), *(forms[k] for k in KINDS),
    )


_PIECES = ArrayType(StructType([StructField("text", StringType()), StructField("cut_start", BooleanType()), StructField("cut_end", BooleanType()), StructField("before", StringType()), StructField("open_line", BooleanType())]))


@F.pandas_udf(_PIECES)
def _split(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("text", "cut_start", "cut_end", "before", "open_line"), piece)) for piece in split_text(t)] for t in texts])


def _counted(pieces: DataFrame, with_forms: bool = True) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [count_chunk(*x, with_forms) for x in zip(batch["text"], batch["cut_start"], batch["cut_end"], batch["before"], batch["open_line"])]
            counts = pd.DataFrame(rows, columns=list(COUNTS), dtype="int64")
            yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), counts], axis=1)

    return pieces.mapInPandas(count, "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS))


def _scanned(texts: DataFrame) -> DataFrame:
    """Each text once: the counts of one of up to ``CHUNK`` characters; of a longer one its forms, which aren't additive, and the text itself."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if len(text) <= CHUNK:
                    rows.append((*count_chunk(text), None))
                else:
                    forms = form_of(text)
                    rows.append((*(forms.get(c.removesuffix("_chars"), 0) for c in COUNTS), text))
            counts = pd.DataFrame(rows, columns=[*COUNTS, "text"]).astype({c: "int64" for c in COUNTS})
            yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), counts], axis=1)

    return texts.mapInPandas(scan, "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in COUNTS) + ", text string")


def text_statistics(documents: DataFrame) -> DataFrame:
    """Statistics of each document's text: one row for each doc_id and different text.

    (doc_id, n_chars, n_words, mean_word_length, symbol_ratio, punct_line_share, common_word_share, kind). Shares of
    nothing are 0; a null text counts as blank, and blank texts are junk. ``kind`` is the form of most characters; ties
    go to prose, then list, then table. Only ``doc_id`` and ``text`` are used. A null doc_id is kept as it is.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    # Kept, as long texts are gone through again: counts and a few long texts.
    scanned = checkpointed(_scanned(texts))
    long = scanned.where(F.col("text").isNotNull())
    pieces = long.select("doc_id", "text_key", F.posexplode(_split("text")).alias("piece_no", "piece")).select("doc_id", "text_key", "piece_no", "piece.*")
    spread = pieces.repartition("doc_id", "piece_no").drop("piece_no")
    columns = ["doc_id", "text_key", *COUNTS]
    merged = _counted(spread, with_forms=False).unionByName(long.select(*columns)).groupBy("doc_id", "text_key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    sums = scanned.where(F.col("text").isNull()).select(*columns).unionByName(merged)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    most = F.greatest(*[F.col(f"{k}_chars") for k in KINDS])
    kind = F.when(most == 0, "junk")
    for k in KINDS:
        kind = kind.when(F.col(f"{k}_chars") == most, k)
    return sums.select(
        "doc_id", "n_chars", "n_words", share("word_chars", "n_words").alias("mean_word_length"), share("n_symbols", "n_chars").alias("symbol_ratio"),
        share("n_punct_lines", "n_lines").alias("punct_line_share"), share("n_common", "n_words").alias("common_word_share"), kind.alias("kind"),
    ).distinct()
