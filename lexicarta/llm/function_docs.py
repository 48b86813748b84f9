"""Functions paired with the running text that documents them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.codescan import documentation, functions, language_of, scan
from lexicarta.runtime import spread

SCHEMA = "id bigint, function_name string, language string, documentation string, doc_words int, code string"

_QUOTES = re.compile(r"^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')([\s\S]*?)(?:\1)?$")
_MARKS = re.compile(r"^[ \t]*(?:/\*[*!]*|\*+/|\*(?!/)|//[/!]*|\#+!?|=begin\b|=end\b)?[ \t]?")
_TAG = re.compile(r"^\s*(?:[@\\](?!code\b|link\b)\w+|:\w+(?:\s+[^:\n]+)?:)")
_SECTION = re.compile(
    r"^(\s*)(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|examples?|keyword args|keyword arguments|other parameters|options|exceptions|errors|panics|safety|usage|\#+\s*(?:arguments|parameters|returns?|errors|panics|examples?|safety))\s*:?\s*$",
    re.I,
)
_TODO = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|bug|wip|optimi[sz]e|review)\b(?=\s*(?:[:(\-]|$)|\s+\S)", re.I)
#: What tool directives begin with.
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier|stylelint|biome|standard|noqa|pylint|flake8|ruff|mypy|pyright|type|isort|yapf|fmt|black|bandit|nosec|ts-\w+|istanbul|c8|v8|webpack\w*|flow|nolint\w*|clang-\w+|cppcheck|iwyu|lint|checkstyle|noinspection|spotless|sonar\w*|nosonar|rubocop|steep|sorbet|typed|frozen_string_literal|go:\w+|\+build|phpcs|phpstan|psalm|codingstandards\w*|rustfmt|clippy|coverage|codecov|pragma|region|endregion)\b(?:\s*[:=]|[-\s](?:ignore|disable|enable|expect|off|on|next|no|start|stop|skip)\b|\s*$|(?=[\w-]*[:(]))|^\W*[\w-]+:\s*(?:ignore|disable|enable|off|skip|noqa)\b|^\W*[\w@]+-(?:ignore|disable|enable|off|expect-error)(?:-[\w-]+)?\b",
    re.I,
)
_CODE = re.compile(
    r"^\s*(?:>>>|\.\.\.(?=\s)|(?:return|raise|throw|if|elif|for|while|switch|const|let|var|import|from|use|def|func|fn|function|class|public|private|static|int|auto|echo|puts|print)\b.*(?:[;{(=]|:$)|[\w.$\[\]'\">-]+\s*(?:[-+*/|&^%]|:|<<|>>)?=(?!=)\s*\S|[\w.$:>-]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]?\s*$|(?=.*[=(\[{])?.*[=()\[\]{}].*[;{}]\s*$|[{}\[\]();]+\s*$)"
)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")


def running_text(raw: str, name: str, python: bool = False) -> str:
    """What remains of a documentation comment without tags, rulers, to-dos, directives, code and repeats of the name."""
    if python and (found := _QUOTES.match(raw.strip())):
        lines = found.group(2).split("\n")
    else:
        lines = [re.sub(r"\s*\*+/\s*$", "", _MARKS.sub("", line, count=1)) for line in raw.split("\n")]
    kept: list[str] = []
    skipping = ""  # tag, todo or section, until a blank line; a section also ends where its indentation does
    indent = 0
    for i, line in enumerate(lines):
        bare = re.sub(r"\{@\w+[^}]*\}", " ", line).rstrip()
        if not re.search(r"[^\W_]", bare):
            if not bare.strip():
                skipping = ""
                kept.append("")
            continue
        underlined = i + 1 < len(lines) and re.fullmatch(r"\s*[-=~]{3,}\s*", lines[i + 1] or "")
        if (section := _SECTION.match(bare)) and (bare.rstrip().endswith(":") or underlined or bare.lstrip().startswith("#")):
            skipping, indent = "section", len(section.group(1))
            continue
        if _TAG.match(bare):
            skipping = "tag"
            continue
        if _TODO.match(bare):
            skipping = "todo"
            continue
        if skipping == "section" and len(bare) - len(bare.lstrip()) <= indent:
            skipping = ""
        if skipping or _DIRECTIVE.match(bare) or _CODE.match(bare):
            continue
        kept.append(bare.strip())
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
    sentences = []
    for paragraph in "\n".join(kept).split("\n\n"):
        for sentence in re.split(r"(?<=[.!?;])\s+", " ".join(paragraph.split())):
            words = {w.lower() for w in _WORD.findall(sentence)} - {"a", "an", "the"}
            if words and not words <= own:
                sentences.append(sentence)
    return " ".join(sentences)


def documented_functions(text: str | None, source_file: str | None, language: str | None) -> Iterator[tuple[str, str, str, int, str]]:
    """Name, language, running text, its number of words and code of each named function that has documentation."""
    known = language_of(source_file, language)
    if not text or not known:
        return
    found = scan(text, known)
    for f in functions(found, known):
        raw = documentation(found, f, known)
        if raw is None:
            continue
        shown = running_text(raw, f.name, known == "python")
        yield f.name, known, shown, len(_WORD.findall(shown)), text[f.start : f.end].strip("\n")


def pairs(df: DataFrame, record_id: Column, content: Column, source_file: Column, language: Column, least_words: int = 4) -> DataFrame:
    """Code-description pairs: one row per documented function of each row of ``df``.

    Functions whose documentation has fewer than ``least_words`` words of running text are left
    out. Rows with null or empty content or of an unknown language give no rows; a repeated row
    gives its functions again under its own id. The language is that of the file's extension, else
    the stated one. Other columns aren't read.
    """
    schema = pa.schema([("id", pa.int64()), ("function_name", pa.string()), ("language", pa.string()), ("documentation", pa.string()), ("doc_words", pa.int32()), ("code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, *row)
                for key, text, path, stated in zip(*(c.to_pylist() for c in batch.columns))
                for row in documented_functions(text, path, stated)
                if row[3] >= least_words
            ]
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    narrow = df.select(record_id.cast("bigint").alias("id"), content.alias("content"), source_file.alias("source_file"), language.alias("language"))
    return spread(narrow.where(F.length("content") > 0)).mapInArrow(run, SCHEMA)
