"""Small text expressions over pages and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a tag, what a handle is made of, and the note of a cut.
TAG_PATTERN = "<[^>]*>"
HANDLE_PATTERN = r"@([0-9A-Za-z_一-龥-]+)"
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"
CLIP_NOTE = "\n\n[已截断]"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def page_text(html: Column | str, n: int | None = None) -> Column:
    """Text of a page without its tags, all of it, or the first ``n`` characters."""
    bare = F.regexp_replace(_col(html), TAG_PATTERN, "")
    return bare if n is None else F.substring(bare, 1, n)


def mentions(text: Column | str) -> Column:
    """``@name`` handles in lower case, each once, in order of first mention."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(HANDLE_PATTERN), 1)
    return F.array_distinct(F.transform(found, F.lower))


def strip_space(text: Column | str) -> Column:
    """White space of any kind taken off both ends."""
    return F.trim(_col(text), F.lit(WHITE_SPACE))


def clip_message(text: Column | str, n: int | None = None) -> Column:
    """Trimmed message, all of it, or cut after ``n`` characters with a note."""
    body = strip_space(text)
    if n is None:
        return body
    return F.when(F.length(body) > n, F.concat(F.substring(body, 1, n), F.lit(CLIP_NOTE))).otherwise(body)
