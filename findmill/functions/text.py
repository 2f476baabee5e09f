"""Text columns with Python-compatible edge cases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from findmill import vocab
from findmill.functions.rounding import round_exact

# Line terminators and white space as Python's str methods see them
_SPACES = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}])"
SPACE = (
    r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


_RARE_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_INDENT = SPACE.replace(r"\s", r" \t\x0b\f\r")  # white space inside a line
_COMMENT_MARK = r"""(?:#|//|/\*|\*|\'\'\'|\"\"\")"""


def unix_lines(text: Column) -> Column:
    """Text in which only line feeds break lines, and every line ends in one.

    Most text has no other break, which one scan for the rare ones tells.
    """
    plain = F.when(text.rlike(_RARE_BREAK), F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)
    return F.when((plain == "") | plain.endswith("\n"), plain).otherwise(F.concat(plain, F.lit("\n")))


def lines(text: Column) -> Column:
    """Array of lines: no trailing empty line, no line at all for ''."""
    parts = F.split(unix_lines(text), "\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def count_lines(unix_text: Column) -> Column:
    """Lines of a text from ``unix_lines``."""
    without = F.replace(unix_text, F.lit("\n"), F.lit(""))
    return (F.octet_length(unix_text) - F.octet_length(without)).cast("bigint")


def count_blank_lines(unix_text: Column) -> Column:
    return F.regexp_count(unix_text, F.lit(rf"(?md)^{_INDENT}*\n")).cast("bigint")


def count_comment_lines(unix_text: Column) -> Column:
    """Lines that start, after white space, with a comment mark of any language."""
    return F.regexp_count(unix_text, F.lit(rf"(?md)^{_INDENT}*{_COMMENT_MARK}")).cast("bigint")


def strip(text: Column) -> Column:
    """Trim every kind of white space (Spark's ``trim`` takes spaces only, unless told).  No regular
    expression looks through the text: only its ends are read."""
    return F.btrim(text, F.lit(_SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def is_blank(line: Column) -> Column:
    return line.rlike(rf"^{SPACE}*\z")


def truncate(text: Column, limit: int) -> Column:
    return F.when(
        F.char_length(text) > limit,
        F.concat(F.left(text, F.lit(limit)), F.lit(vocab.TRUNCATION_NOTICE)),
    ).otherwise(text)


def labelled_score(text: Column, label: str) -> Column:
    """First ``label: 85`` in the text, at most 100; 0.0 when there is none."""
    return F.coalesce(score_by_pattern(text, rf"\Q{label}\E[:\s]+(\d{{1,3}})"), F.lit(0.0))


def score_by_pattern(text: Column, pattern: str) -> Column:
    """First group of ``pattern`` as a score, at most 100; NULL without a match."""
    found = F.nullif(F.regexp_extract(text, f"(?i){pattern}", 1), F.lit(""))
    return F.when(found.isNotNull(), F.least(found.try_cast("double"), F.lit(100.0)))


def mean_of_positive(scores: Column) -> Column:
    """Mean of the positive elements to one decimal; NULL when there are none."""
    kept = F.filter(scores, lambda s: s > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s)
    return F.when(F.size(kept) > 0, round_exact(total / F.size(kept), 1))


def extension(path: Column) -> Column:
    """Suffix of the file name without the dot, as written."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)


def repo_language(path: Column) -> Column:
    ext = F.lower(extension(path))
    table = F.create_map(
        *[F.lit(x) for kv in vocab.LANGUAGE_BY_EXTENSION.items() for x in kv]
    )
    return F.try_element_at(table, ext)
