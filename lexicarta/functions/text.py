"""Text expressions: stripping, previews, paths, Markdown tables and counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for the row, however often a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any script and the separators U+001C to U+001F."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True where only white space is left; null stays null."""
    return F.length(strip(text)) == 0


def preview(text: Column, size: int = 200) -> Column:
    """The first ``size`` code points."""
    return F.substring(text, 1, size)


def lines(text: Column) -> Column:
    """All lines, trailing empty ones included."""
    return F.split(text, "\n", -1)


def paragraphs(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(lines(text), lambda line: ~is_blank(line))


def extension(path: Column) -> Column:
    """The last suffix of a file name with its dot, as written; empty if there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    """The file name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]+$", "")


def indent(line: Column) -> Column:
    """Leading white space characters."""
    return F.length(F.regexp_extract(line, r"(?U)^(\s*)", 1))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def markdown_row(cells: Column) -> Column:
    """One row of a Markdown table; null cells are empty."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """A Markdown table of an array of rows whose first is the header and sets the rule's width; no rows give an empty text."""
    rule = markdown_row(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), markdown_row)
    table = F.array_join(F.concat(F.array(markdown_row(F.get(rows, F.lit(0))), rule), body), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, table).otherwise("")


def listed_ids(text: Column) -> Column:
    """Ids of a comma-separated list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def with_language(code: Column, language: Column) -> Column:
    """Code under a line that names its language; unchanged where none is known."""
    return F.when(language.isNotNull(), F.concat(F.lit("# Language: "), language, F.lit("\n"), code)).otherwise(code)
