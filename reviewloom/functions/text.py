"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks a script-language trim removes.
BLANKS = (
    " \t\n\u000b\f\r"
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Prefixes that mark a commented-out line.
COMMENT_MARKS = ("//", "*", "#")

REDACTED = "***REDACTED***"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trimmed_long(text: Column) -> Column:
    """The same for long texts; it names ``text`` more than once.

    Trimming at the end walks through the whole text, with a copy of every character, so it is
    left out where the last character is no blank.
    """
    ends_blank = F.contains(F.lit(BLANKS), F.substring(text, -1, 1))
    return F.when(~ends_blank, left_trimmed(text)).otherwise(trimmed(text))


def left_trimmed(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def non_blank(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def is_commented(line: Column) -> Column:
    head = left_trimmed(line)
    test = F.lit(False)
    for mark in COMMENT_MARKS:
        test = test | head.startswith(mark)
    return test


def redacted(match: Column) -> Column:
    """First six characters of a secret and a fixed mask."""
    return F.concat(F.substring(match, 1, 6), F.lit(REDACTED))


def short_sha(sha: Column) -> Column:
    return F.nullif(F.substring(sha, 1, 7), F.lit(""))


def unescape_xml(text: Column, apostrophe: bool) -> Column:
    """Entity replacement with the ampersand first, so doubly escaped text opens twice."""
    pairs = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
    if apostrophe:
        pairs.append(("&#39;", "'"))
    for entity, character in pairs:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def megabytes(size_kb: Column, digits: int) -> Column:
    """Kilobytes shown as megabytes with fixed digits, ties rounded up."""
    return F.format_string(f"%.{digits}f", size_kb.cast("double") / 1024)


def number_or_one(text: Column) -> Column:
    """Attribute text as int; zero, blank and non-numbers give one."""
    return F.coalesce(F.nullif(text.try_cast("int"), F.lit(0)), F.lit(1))


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, HH:mm")


def line_label(line: Column) -> Column:
    return F.coalesce(line.cast("string"), F.lit("?"))
