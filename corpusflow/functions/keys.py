"""Normal forms of keys that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """Trimmed and lower-cased, with blanks and underscores as hyphens; null stays null."""
    return F.regexp_replace(F.lower(F.trim(source)), "[ _]", "-")


def language_key(lang: Column) -> Column:
    """The first two letters, lower-cased; null stays null."""
    return F.lower(F.substring(F.trim(lang), 1, 2))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down, and at least 1; null stays null."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("long")))


def week_of(time: Column) -> Column:
    """The Monday of the UTC week as YYYY-MM-DD, whatever the session's time zone."""
    return F.date_format(F.date_trunc("week", F.to_utc_timestamp(time, F.current_timezone())), "yyyy-MM-dd")
