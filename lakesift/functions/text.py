"""Column functions on texts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token characters are ASCII letters and digits and everything beyond ASCII.
NOT_TOKEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FRONTMATTER = r"(?s)^---\n.*?\n---\n"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text; only ASCII letters change case."""
    return F.filter(F.split(lower_ascii(text), NOT_TOKEN), lambda t: t != "")


def newlines(text: Column) -> Column:
    """Line ends as the single character that is hashed."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(newlines(text), 256)


def body(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(text, FRONTMATTER, "")


def heading(text: Column) -> Column:
    """The first line that starts with # and holds more than that, without it; else null."""
    found = F.regexp_extract(text, r"(?m)^#[# ]*([^#\s][^\n]*)$", 1)
    return F.nullif(F.trim(found), F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def relative_path(path: Column, root: Column) -> Column:
    """The path below ``root``; the bare file name where the path lies elsewhere."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))


def slice_text(text: Column, pos: Column, length: Column) -> Column:
    """Code points ``pos .. pos + length``, pos from 0."""
    return F.substring(text, pos + 1, length)


def preview(text: Column, n: int = 200) -> Column:
    return F.trim(F.translate(F.substring(text, 1, n), "\n", " "))


def score_bar(score: Column, low: float = -10.0, high: float = 10.0, width: int = 10) -> Column:
    """A bar whose length places the score between ``low`` and ``high``."""
    share = F.least(F.greatest((score - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    full = F.bround(share * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def seconds_of(duration: Column) -> Column:
    """Seconds of a text such as 7d or 2w; null for anything else."""
    n = F.regexp_extract(duration, r"^(\d+)[dw]$", 1)
    return F.when(n != "", n.cast("long") * F.when(F.endswith(duration, F.lit("w")), 604800).otherwise(86400))
