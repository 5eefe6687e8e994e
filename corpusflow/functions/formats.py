"""File formats by name and extension."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical format of each accepted name or extension.
FORMATS = {
    "txt": "text", "text": "text",
    "md": "markdown", "markdown": "markdown",
    "html": "html", "htm": "html",
    "json": "json",
    "xml": "xml",
    "pdf": "pdf",
    "docx": "docx",
    "xlsx": "xlsx",
    "pptx": "pptx",
    "jpg": "image", "jpeg": "image", "png": "image", "bmp": "image", "tiff": "image", "tif": "image", "webp": "image",
    "mp3": "audio", "wav": "audio", "m4a": "audio",
    "mp4": "video", "mov": "video", "webm": "video",
}


def canonical_format(name: Column) -> Column:
    """The canonical name of a format or extension in any case, with or without a leading dot; unknown and null are ``text``."""
    table = F.create_map(*map(F.lit, chain.from_iterable(FORMATS.items())))
    return F.coalesce(F.element_at(table, F.regexp_replace(F.lower(F.trim(name)), r"^\.", "")), F.lit("text"))


def detect_format(filename: Column, explicit: Column) -> Column:
    """The explicit format in lower case if there is one, else a known extension of the name, else ``text``."""
    extension = F.regexp_extract(F.lower(filename), r"\.([^.]+)$", 1)
    known = F.when(extension.isin(*FORMATS), extension)
    return F.coalesce(F.nullif(F.lower(explicit), F.lit("")), known, F.lit("text"))
