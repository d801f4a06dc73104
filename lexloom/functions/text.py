"""Cleaning of legal text and small text scalars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that Python strips from a text's ends.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
#: As BLANK, without the space.
BUT_SPACE = BLANK.replace(r"\x1C-\x20", r"\x1C-\x1F")
INLINE = r"[ \t   -   　]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), rf"{BLANK}+\z", "")


def clean_whitespace(text: Column) -> Column:
    """One kind of line end, no zero-width characters, single spaces within lines, at most one blank line, no blank ends."""
    for pattern, new in ((r"\r\n?", "\n"), (r"\f", "\n\n"), (r"\x0B", "\n"), (r"[​-‍⁠﻿]", ""), (f"{INLINE}+", " ")):
        text = F.regexp_replace(text, pattern, new)
    ends = BLANK.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
    text = F.regexp_replace(text, f"(?md)^{ends}+|{ends}+$", "")
    return stripped(F.regexp_replace(text, "\n{3,}", "\n\n"))


def drop_page_lines(text: Column) -> Column:
    """Without lines that hold only a page number."""
    text = F.regexp_replace(text, r"(?md)^[ \t]*[-–—]?[ \t]*\d{1,4}[ \t]*[-–—]?[ \t]*$", "")
    text = F.regexp_replace(text, r"(?imd)^[ \t]*page[ \t]+\d+(?:[ \t]+of[ \t]+\d+)?[ \t]*$", "")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def folded(text: Column) -> Column:
    """Single spaces, no blank ends, lower case; empty for null."""
    single = F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}{{2,}}|{BUT_SPACE}", " ")  # lone spaces are left alone
    return F.lower(F.trim(single))


def fingerprint(*texts: Column) -> Column:
    """SHA-256 over the folded texts, set off by U+001F."""
    return F.sha2(F.concat_ws("\x1f", *[folded(t) for t in texts]), 256)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def preview(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def tokens(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def let(value: Column, then) -> Column:
    """then(value), where the value is worked out once for a row."""
    return F.get(F.transform(F.array(value), then), 0)
