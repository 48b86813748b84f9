"""Source files into module and element chunks, all within the row of each file."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lexicarta.functions.text import indent, let, lines, occurrences, preview, stem, strip

#: Names, line comments and keywords of the languages whose elements are known.
LANGUAGES = {
    ".py": ("Python", "#", ("def",), ("class",)),
    ".js": ("JavaScript", "//", ("function", "const", "let", "var"), ("class",)),
    ".ts": ("TypeScript", "//", ("function", "const", "let", "var"), ("class", "interface", "type")),
    ".java": ("Java", "//", ("public", "private", "protected", "static"), ("class", "interface", "enum")),
    ".cpp": ("C++", "//", (), ("class", "struct")),
    ".go": ("Go", "//", ("func",), ("type", "struct", "interface")),
    ".rb": ("Ruby", "#", ("def",), ("class", "module")),
    ".rs": ("Rust", "//", ("fn",), ("struct", "enum", "trait", "impl")),
}
#: Lines that open an element: indentation, keyword and name; the name's group.
OPENERS = {
    ".py": (r"^(\s*)(def|class)\s+(\w+)", 3),
    ".js": (r"^(\s*)(function|class|const|let|var)\s+(\w+)", 3),
    ".ts": (r"^(\s*)(function|class|const|let|var)\s+(\w+)", 3),
    ".java": (r"^(\s*)(public|private|protected|static).*?(class|void|int|String|boolean)\s+(\w+)", 4),
}
OTHER_OPENER = (r"^(\s*)(def|function|class|fn|func)\s+(\w+)", 3)
#: Import lines by extension, and the words that complexity counts.
IMPORTS = {
    ".py": r"^(import|from)\s+", ".js": r"^(import|require)\s+", ".ts": r"^(import|require)\s+", ".jsx": r"^(import|require)\s+", ".tsx": r"^(import|require)\s+",
    ".java": r"^import\s+",
}
BRANCHES = ("if", "else", "elif", "for", "while", "switch", "case", "try", "catch", "except")


def complexity(code: Column) -> Column:
    """1 and every branch word that stands between spaces or between a space and a bracket."""
    total = F.lit(1)
    for word in BRANCHES:
        total = total + occurrences(code, f" {word} ") + occurrences(code, f" {word}(")
    return total


def _by_extension(ext: Column, values: dict[str, Column], otherwise: Column) -> Column:
    chosen = otherwise
    for key, value in values.items():
        chosen = F.when(ext == key, value).otherwise(chosen)
    return chosen


def imports(code_lines: Column, ext: Column) -> Column:
    """Import lines, stripped, in order; none for languages without a rule."""
    bare = F.transform(code_lines, strip)

    def matching(pattern: str) -> Column:
        return F.filter(bare, lambda line: line.rlike(pattern))

    return _by_extension(ext, {e: matching(p) for e, p in IMPORTS.items()}, F.array().cast("array<string>"))


def _opener(line: Column, ext: Column, group: int) -> Column:
    pick = lambda rule: F.regexp_extract(line, f"(?U){rule[0]}", rule[1] if group == 3 else group)
    return _by_extension(ext, {e: pick(rule) for e, rule in OPENERS.items()}, pick(OTHER_OPENER))


def elements(sources: DataFrame) -> DataFrame:
    """``sources`` with ``code_lines``, ``code_imports`` and ``code_elements``.

    ``sources`` has ``source_file, extension, code``. An element runs from its opening line to the last
    line before the next one that is neither blank nor a comment and indented no deeper. A function
    after any class is a method of the nearest class above, however it is indented. Null code gives no elements.
    """
    ext = F.col("extension")
    comment = _by_extension(ext, {e: F.lit(v[1]) for e, v in LANGUAGES.items()}, F.lit("//"))
    classes = _by_extension(ext, {e: F.array(*[F.lit(w) for w in v[3]]) for e, v in LANGUAGES.items()}, F.array(F.lit("class")))
    functions = _by_extension(ext, {e: F.array(*[F.lit(w) for w in v[2]]).cast("array<string>") for e, v in LANGUAGES.items()}, F.array().cast("array<string>"))
    numbered = F.transform("code_lines", lambda line, i: F.struct(i.alias("start"), line.alias("line")))
    opened = F.transform(
        F.filter(numbered, lambda e: _opener(e["line"], ext, 2) != ""),
        lambda e: F.struct(e["start"].alias("start"), F.length(_opener(e["line"], ext, 1)).alias("ind"), _opener(e["line"], ext, 2).alias("keyword"), _opener(e["line"], ext, 3).alias("name")),
    )
    solid = F.filter(
        F.transform("code_lines", lambda line, i: F.struct(i.alias("i"), indent(line).alias("ind"), strip(line).alias("s"))),
        lambda e: (e["s"] != "") & ~F.startswith(e["s"], F.col("_comment")),
    )
    shaped = sources.withColumns({"code_lines": lines(F.col("code")), "_comment": comment, "_classes": classes, "_functions": functions})
    shaped = shaped.withColumn("code_imports", imports(F.col("code_lines"), ext))

    first = shaped.withColumns({"_open": opened, "_solid": solid})
    is_class = F.transform("_open", lambda o: F.array_contains("_classes", o["keyword"]))
    ends = _ends(F.col("_open")["start"], F.col("_open")["ind"], is_class, F.col("_solid")["i"], F.col("_solid")["ind"], F.coalesce(F.size("code_lines"), F.lit(0)))

    def finish(e: Column, i: Column) -> Column:
        count = F.size("_open")
        above = F.get(F.col("_ends"), count + i)
        parent = F.when(above >= 0, F.get(F.col("_open"), above)["name"])
        called = F.array_contains("_functions", e["keyword"]) | e["keyword"].isin("public", "private", "protected", "static")
        kind = F.when(F.array_contains("_classes", e["keyword"]), "class").when(called & parent.isNotNull(), "method").otherwise("function")
        return F.struct(
            e["start"].alias("start"), F.get(F.col("_ends"), i).alias("stop"), kind.alias("kind"), e["name"].alias("name"), F.when(kind == "method", parent).alias("parent"),
        )

    found = first.withColumn("_ends", ends).withColumn("code_elements", F.transform("_open", finish))
    return found.drop("_comment", "_classes", "_functions", "_open", "_solid", "_ends")


@F.pandas_udf(ArrayType(IntegerType()))
def _ends(starts: pd.Series, indents: pd.Series, classes: pd.Series, solid: pd.Series, solid_indents: pd.Series, size: pd.Series) -> pd.Series:
    """The last line of each element and, after these, the place of the last class opened up to it, or -1.

    One pass from the end over the solid lines keeps those that can end an element: nearer ones are indented deeper.
    """
    out = []
    for opens, inds, kinds, lines_, depths, count in zip(starts, indents, classes, solid, solid_indents, size):
        if opens is None or lines_ is None:
            out.append(None)
            continue
        stops, stack, j = [count - 1] * len(opens), [], len(lines_) - 1  # the stack's indentations grow towards its end, the nearest line
        for e in range(len(opens) - 1, -1, -1):
            while j >= 0 and lines_[j] > opens[e]:
                while stack and stack[-1][0] >= depths[j]:
                    stack.pop()
                stack.append((depths[j], lines_[j]))
                j -= 1
            at = bisect_right(stack, inds[e], key=lambda entry: entry[0])
            if at:
                stops[e] = stack[at - 1][1] - 1
        parents, last = [], -1
        for e, is_class in enumerate(kinds):
            last = e if is_class else last
            parents.append(last)
        out.append([int(v) for v in (*stops, *parents)])
    return pd.Series(out)


@F.pandas_udf(ArrayType(IntegerType()))
def _outside(starts: pd.Series, stops: pd.Series, size: pd.Series) -> pd.Series:
    """The lines that no element covers; elements are in the order of their starts."""
    out = []
    for begin, end, count in zip(starts, stops, size):
        free, at = [], 0
        for a, b in zip(begin if begin is not None else (), end if end is not None else ()):
            free += range(at, a)
            at = max(at, b + 1)
        out.append([*free, *range(at, count)])
    return pd.Series(out)


def code_chunks(sources: DataFrame, least: int = 100, context: bool = True) -> DataFrame:
    """Module and element chunks of files whose language is known.

    The module chunk holds what no element covers, after all imports; an element chunk its lines
    after the nearest line of its class within the 20 lines above and the first five imports. Both
    are dropped below ``least`` characters, so small elements are in no chunk. ``chunk_id`` counts
    the rest from 0, the module first.
    """
    known = elements(sources.where(F.col("extension").isin(*LANGUAGES)))
    known = known.withColumn("_outside", _outside(F.col("code_elements")["start"], F.col("code_elements")["stop"], F.coalesce(F.size("code_lines"), F.lit(0))))
    language = _by_extension(F.col("extension"), {e: F.lit(v[0]) for e, v in LANGUAGES.items()}, F.lit("Unknown"))
    none = F.lit(None).cast("string")
    nothing = F.array().cast("array<string>")

    def element(e: Column, file: Column) -> Column:
        body = F.array_join(F.slice(file["lines"], e["start"] + 1, e["stop"] - e["start"] + 1), "\n")
        first = F.greatest(F.lit(0), e["start"] - 20)
        heads = F.filter(F.slice(file["lines"], first + 1, e["start"] - first), lambda line: F.contains(line, F.concat(F.lit("class "), e["parent"])))
        lead = F.concat(F.coalesce(F.slice(heads, 1, 1), nothing), F.slice(file["imports"], 1, 5)) if context else nothing

        def shape(c: Column) -> Column:
            full = F.when(F.size(c["lead"]) > 0, F.concat(F.array_join(c["lead"], "\n"), F.lit("\n\n"), c["body"])).otherwise(c["body"])
            return F.struct(
                e["kind"].alias("element_type"), e["name"].alias("element_name"), e["parent"].alias("parent_class"), e["start"].alias("line_start"), e["stop"].alias("line_end"),
                complexity(c["body"]).alias("complexity_score"), F.floor(e["start"] / 100).cast("int").alias("page_number"), full.alias("content"), F.length(c["body"]).alias("_size"),
            )

        return let(F.struct(lead.alias("lead"), body.alias("body")), shape)

    def top(file: Column) -> Column:
        outside = F.transform(file["outside"], lambda i: F.get(file["lines"], i))

        def shape(module: Column) -> Column:
            full = F.when(F.size(file["imports"]) > 0, F.concat(F.array_join(file["imports"], "\n"), F.lit("\n\n"), module)).otherwise(module)
            return F.struct(
                F.lit("module").alias("element_type"), stem(F.col("source_file")).alias("element_name"), none.alias("parent_class"), F.lit(0).alias("line_start"),
                F.size(file["lines"]).alias("line_end"), complexity(full).alias("complexity_score"), F.lit(0).alias("page_number"), full.alias("content"), F.length(module).alias("_size"),
            )

        return let(strip(F.array_join(outside, "\n")), shape)

    file = F.struct(F.col("code_lines").alias("lines"), F.col("code_elements").alias("elements"), F.col("code_imports").alias("imports"), F.col("_outside").alias("outside"))
    every = let(file, lambda f: F.concat(F.array(top(f)), F.transform(f["elements"], lambda e: element(e, f))))
    parts = F.filter(every, lambda c: c["_size"] >= least)
    return (
        known.select("source_file", "extension", language.alias("language"), F.posexplode(parts).alias("chunk_id", "c"))
        .select("source_file", "chunk_id", "extension", "language", "c.*")
        .drop("_size")
        .withColumns({"text_length": F.length("content"), "preview": preview(F.col("content")), "chunk_type": F.lit("code")})
    )
