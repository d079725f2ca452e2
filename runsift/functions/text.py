"""Line and whitespace expressions. Everything here is Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes for the two notions of whitespace in use.
# CONTROL_WS is every code point up to U+0020; SPACE_WS is Unicode white space
# without the no-break spaces.
CONTROL_WS = r"\x00-\x20"
SPACE_WS = (
    r"\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}"
    r"\x{2028}\x{2029}\x{205F}\x{3000}"
)

_NEWLINE = r"\r\n?|\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so ``body`` may use it often."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def trim_ctl(text: Column) -> Column:
    """Drop every leading and trailing character up to U+0020."""
    return F.btrim(text, F.lit("".join(map(chr, range(0x21)))))


def strip_ws(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.regexp_replace(text, f"^[{SPACE_WS}]+|(?<![{SPACE_WS}])[{SPACE_WS}]+\\z", "")


def strip_trailing(text: Column) -> Column:
    return F.regexp_replace(text, f"(?<![{SPACE_WS}])[{SPACE_WS}]+\\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE_WS}]")


def nn(text: Column) -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(text, F.lit(""))


def lines_of(text: Column) -> Column:
    """Lines without the empty one after a final line break; '' has no lines."""
    # Text without carriage returns splits on one plain character, which needs no regex.
    body = F.when(text.endswith("\n"), F.left(text, F.char_length(text) - 1)).otherwise(text)
    mixed = F.split(F.regexp_replace(text, f"(?:{_NEWLINE})\\z", ""), _NEWLINE)
    return F.when(text == "", F.array().cast("array<string>")).when(
        text.contains("\r"), mixed).otherwise(F.split(body, "\n"))


def lines_raw_of(text: Column) -> Column:
    """Lines including the empty one after a final line break (used by diffs)."""
    return F.split(text, r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def non_blank(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_blank(x))


def any_line(lines: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.exists(lines, predicate)


def count_lines(lines: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(lines, predicate))


def drop_first(lines: Column, n: Column | int) -> Column:
    """All but the first ``n`` elements."""
    start = F.lit(n) + 1 if isinstance(n, int) else n + 1
    return F.slice(lines, start, F.greatest(F.size(lines), F.lit(1)))


def first_match(lines: Column, pattern: str, group: int = 0) -> Column:
    """Capture of the first line that matches, or NULL."""
    hit = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1))
    return F.regexp_extract(hit, pattern, group)


def last_match(lines: Column, pattern: str, group: int = 0) -> Column:
    """Capture of the last line that matches, or NULL."""
    hit = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(-1))
    return F.regexp_extract(hit, pattern, group)


def contains_any(text: Column, literals: list[str]) -> Column:
    out = F.lit(False)
    for value in literals:
        out = out | text.contains(value)
    return out


def drop_overwritten(text: Column) -> Column:
    """Delete what a lone carriage return overwrites, up to the last one of a line.

    Anchored at line starts, so a long line is read once.
    """
    return F.when(text.contains("\r"), F.regexp_replace(text, r"(?md)^[^\n]*\r(?!\n)", "")).otherwise(text)


def decode_text(raw: Column, max_line_chars: int = 1 << 20) -> Column:
    """Bytes to text: lossy UTF-8, CRLF as one break, text before a lone CR is
    overwritten, and a line above the cap is continued on the next line."""
    text = F.make_valid_utf8(raw.cast("string"))
    text = drop_overwritten(text)
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    capped = F.regexp_replace(text, rf"([^\n]{{{max_line_chars}}})(?=[^\n])", "$1\n")
    return F.when(F.length(text) > max_line_chars, capped).otherwise(text)
