"""Text functions as Column expressions: labels, redaction, progress, file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_label(text: Column, prompts: list[tuple[str, str]], other: str | None = None) -> Column:
    """Lower case, dots to spaces, spaces collapsed; the first prompt contained names the label."""
    clean = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("."), F.lit(" ")), r" +", " "))
    whole = reduce(lambda c, p: c.when(F.contains(clean, F.lit(p[0])), p[1]), prompts, F.when(F.lit(False), ""))
    return whole.otherwise(F.lit(other) if other is not None else clean)


def redacted(text: Column) -> Column:
    """Secrets and paths of a message are masked; keys stay readable."""
    secret = F.regexp_replace(text, r"(?i)(token|password|secret|key)=([^ &\n]+)", "$1=***")
    return F.regexp_replace(secret, r"(?i)(https?://)[^/ \n]+", "$1<host>")


def progress(line: Column) -> Column:
    """n of ``n/total`` as a share; NULL without one."""
    n, total = (F.regexp_extract(line, r"(\d+)/(\d+)", k).try_cast("double") for k in (1, 2))
    return F.try_divide(n, total)


def safe_filename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def shown(value: Column) -> Column:
    """Two decimals, a dash for unknown."""
    return F.when(value.isNull(), "-").otherwise(F.format_string("%.2f", value))


def prompt(phrases: Column) -> Column:
    """Phrases joined by '. ' and closed by a dot; spaces around and dots behind a phrase go, empty ones are left out. NULL without any."""
    said = F.filter(F.transform(phrases, lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", ""))), lambda x: x != "")
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit(".")))


def stripped(value: Column) -> Column:
    """A required text without white space at its ends; NULL if nothing is left."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def bounded(value: Column, least: int, most: int) -> Column:
    """Whether a required text, stripped, has ``least`` to ``most`` characters."""
    return F.coalesce(F.length(stripped(value)).between(least, most), F.lit(False))
