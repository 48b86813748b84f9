"""Comments, strings and named functions of source text, by island grammars.

Per language only comments, strings, annotations, signatures and balanced bodies are recognised;
everything else is water and skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The language of a file extension.
LANGUAGES = {
    "py": "python", "pyi": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "java": "java", "kt": "java", "cs": "java",
    "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c",
    "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
}

_NAMES = {"cpp": "c", "c++": "c", "js": "javascript", "ts": "typescript", "golang": "go", "py": "python", "rb": "ruby", "rs": "rust"}

_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*"?', r"'(?:[^'\\\n]|\\[\s\S])*'?"
_BLOCK, _LINE = r"/\*[\s\S]*?(?:\*/|\Z)", r"//[^\n]*"
_TICK = r"`(?:[^`\\]|\\[\s\S])*(?:`|\Z)"
_REGEX = r"(?<=[(,=:\[!&|?{};+])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

#: Comment and string islands by language: group c is a comment, group s a string.
_ISLANDS = {
    "python": re.compile(rf"(?P<c>\#[^\n]*)|(?P<s>(?<!\w)[rRbBuUfF]{{0,2}}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|{_DOUBLE}|{_SINGLE}))"),
    "ruby": re.compile(rf"(?P<c>^=begin[\s\S]*?(?:^=end[^\n]*|\Z)|(?<![$\w])\#(?!\{{)[^\n]*)|(?P<s><<[~-]?(?P<q>['\"]?)(?P<h>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?^[ \t]*(?P=h)\b|{_DOUBLE}|{_SINGLE}|{_TICK})", re.M),
    "javascript": re.compile(rf"(?P<c>{_BLOCK}|{_LINE})|(?P<s>{_DOUBLE}|{_SINGLE}|{_TICK}|{_REGEX})"),
    "java": re.compile(rf'(?P<c>{_BLOCK}|{_LINE})|(?P<s>"""[\s\S]*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE})'),
    "c": re.compile(rf'(?P<c>{_BLOCK}|{_LINE})|(?P<s>R"(?P<h>[^()\s\\]{{0,16}})\([\s\S]*?\)(?P=h)"|{_DOUBLE}|(?<!\d){_SINGLE})'),
    "go": re.compile(rf"(?P<c>{_BLOCK}|{_LINE})|(?P<s>{_DOUBLE}|{_SINGLE}|`[^`]*(?:`|\Z))"),
    "rust": re.compile(rf"(?P<c>{_BLOCK}|{_LINE})|(?P<s>\bb?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))')"),
    "php": re.compile(rf"(?P<c>{_BLOCK}|{_LINE}|\#(?!\[)[^\n]*)|(?P<s><<<[ \t]*(?P<q>['\"]?)(?P<h>\w+)(?P=q)\n[\s\S]*?^[ \t]*(?P=h)\b|\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|'(?:[^'\\]|\\[\s\S])*(?:'|\Z))", re.M),
}
_ISLANDS["typescript"] = _ISLANDS["javascript"]

#: Words that stand before a bracket without being the name of what is defined.
_NOT_NAMES = frozenset(
    "if for while switch catch return function new else do try with await typeof throw yield case super sizeof using synchronized match loop unless until elsif elseif foreach and or not in is lambda assert delete constructor_ defined static_assert alignof decltype declare".split()
)

#: What stands for the characters of comments and strings in the water.
COMMENT, STRING = "\x02", "\x03"

_CLOSE = {"(": ")", "{": "}", "[": "]"}


def language_of(source_file: str | None, stated: str | None) -> str | None:
    """The language by the file's extension, else as stated; None if neither is known."""
    extension = (source_file or "").rpartition(".")[2].strip().lower()
    if extension in LANGUAGES:
        return LANGUAGES[extension]
    stated = (stated or "").strip().lower()
    stated = _NAMES.get(stated, stated)
    return stated if stated in _ISLANDS else None


@dataclass
class Scan:
    """Source text, its water without comments and strings (of equal length), and these islands."""

    text: str
    code: str
    comments: list[tuple[int, int]]
    strings: list[tuple[int, int]]


def scan(text: str, language: str) -> Scan:
    """Split ``text`` into code, comments and strings."""
    comments: list[tuple[int, int]] = []
    strings: list[tuple[int, int]] = []
    parts: list[str] = []
    at = 0
    for found in _ISLANDS[language].finditer(text):
        start, end = found.span()
        (comments if found.group("c") is not None else strings).append((start, end))
        parts.append(text[at:start])
        island = text[start:end]
        fill = COMMENT if comments and comments[-1][0] == start else STRING
        parts.append("\n".join(fill * len(x) for x in island.split("\n")) if "\n" in island else fill * len(island))
        at = end
    parts.append(text[at:])
    return Scan(text, "".join(parts), comments, strings)


def closing(code: str, at: int) -> int:
    """Index of the bracket that closes the one at ``at``; -1 if none does."""
    opened, closed, depth = code[at], _CLOSE[code[at]], 0
    for found in re.compile(f"[{re.escape(opened + closed)}]").finditer(code, at):
        depth += 1 if found.group() == opened else -1
        if not depth:
            return found.start()
    return -1


_PARAMS_THEN = {
    "javascript": re.compile(r"\s*+(?::[^={;]*+)?\{"),
    "typescript": re.compile(r"\s*+(?::\s*+(?:\{[^}]*\}\s*+)?[^={;]*+)?\{"),
    "java": re.compile(r"\s*(?:throws\s+[\w.,\s<>]+)?\{"),
    "c": re.compile(r"\s*+(?:(?:const|noexcept|override|final|volatile|&&?|->[\w:<>,&*\s]*+)\s*+)*+(?::[^;{]*+)?\{"),
}

_DEFS = {
    "python": re.compile(r"^(?P<lead>[ \t]*+)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*(?P<p>\()", re.M),
    "go": re.compile(r"^(?P<lead>[ \t]*+)func[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?P<p>\()", re.M),
    "rust": re.compile(r"^(?P<lead>[ \t]*+)(?:(?:pub(?:[ \t]*\([^)]*\))?|const|async|unsafe|default|extern(?:[ \t]*\"?\w*\"?)?)[ \t]+)*fn[ \t]+(?P<name>\w+)[ \t]*(?:<[^;{(]*>)?[ \t]*(?P<p>\()", re.M),
    "ruby": re.compile(r"^(?P<lead>[ \t]*+)(?:(?:private|public|protected|module_function|private_class_method)[ \t]+)?def[ \t]+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?)", re.M),
    "php": re.compile(r"^(?P<lead>[ \t]*+)(?:(?:abstract|final|public|private|protected|static)[ \t]+)*function[ \t]*&?[ \t]*(?P<name>\w+)[ \t]*(?P<p>\()", re.M | re.I),
    "javascript": re.compile(
        r"^(?P<lead>[ \t]*+)(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:public|private|protected|static|readonly|override|abstract|declare)[ \t]+)*(?:async[ \t]+)?(?:function[ \t]*\*?[ \t]*|(?:get|set)[ \t]+(?=[\w$#]+[ \t]*\()|\*[ \t]*)?(?P<name>[\w$#]+)[ \t]*\??[ \t]*(?:<[^;{()]*>)?[ \t]*(?P<p>\()",
        re.M,
    ),
    "java": re.compile(r"^(?P<lead>[ \t]*+)(?:@\w+(?:\([^)\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|override|virtual|async|internal|sealed)[ \t]+)*(?:<[^;{()\n]*>[ \t]*)?(?:[\w.]+(?:<[^;{()\n]*>)?(?:\[\])*[ \t]+)?(?P<name>\w+)[ \t]*(?P<p>\()", re.M),
    "c": re.compile(r"^(?P<lead>[ \t]*+)(?:template[ \t]*<[^;{()]*>[ \t]*)?(?:[\w:]+(?:<[^;{()\n]*>)?(?:[ \t]*[*&]+[ \t]*|[ \t]+))+(?:[\w]+(?:<[^;{()\n]*>)?::)*(?P<name>~?\w+)[ \t]*(?P<p>\()", re.M),
}
_DEFS["typescript"] = _DEFS["javascript"]

#: A function assigned to a name.
_ASSIGNED = {
    "javascript": re.compile(
        r"^(?P<lead>[ \t]*+)(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:const|let|var|public|private|protected|static|readonly)[ \t]+)*(?:[\w$]+\.)*(?P<name>[\w$#]+)[ \t]*(?::[ \t]*(?!function|async)[^=;\n]*?)?[ \t]*[=:][ \t]*(?:async[ \t]*)?(?:function\b[ \t]*\*?[ \t]*[\w$]*[ \t]*(?=\()|(?=\(|<)|(?P<bare>[\w$]+)[ \t]*=>)",
        re.M,
    ),
    "go": re.compile(r"^(?P<lead>[ \t]*+)(?:var[ \t]+)?(?P<name>\w+)[ \t]*:?=[ \t]*func[ \t]*(?=\()", re.M),
    "rust": re.compile(r"^(?P<lead>[ \t]*+)(?:let|const|static)[ \t]+(?:mut[ \t]+)?(?P<name>\w+)[ \t]*(?::[^=\n]*)?=[ \t]*(?:move[ \t]*)?\|", re.M),
    "ruby": re.compile(r"^(?P<lead>[ \t]*+)(?:(?P<name>\w+)[ \t]*=[ \t]*(?:lambda|proc|Proc\.new|->)|define_method\(?[ \t]*:(?P<name2>\w+))", re.M),
    "php": re.compile(r"^(?P<lead>[ \t]*+)\$(?P<name>\w+)[ \t]*=[ \t]*(?:static[ \t]+)?(?:function|fn)[ \t]*&?[ \t]*(?=\()", re.M),
    "c": re.compile(r"^(?P<lead>[ \t]*+)(?:(?:static|const|constexpr|inline)[ \t]+)*auto[ \t]+(?P<name>\w+)[ \t]*=[ \t]*\[[^\]\n]*\][ \t]*(?=\(|\{)", re.M),
    "python": re.compile(r"(?!)"),
    "java": re.compile(r"^(?P<lead>[ \t]*+)(?:(?:public|private|protected|static|final)[ \t]+)*[\w.]+(?:<[^;{()\n]*>)?[ \t]+(?P<name>\w+)[ \t]*=[ \t]*(?:\([^()\n]*\)|\w+)[ \t]*->", re.M),
}
_ASSIGNED["typescript"] = _ASSIGNED["javascript"]

_ARROW = re.compile(r"\s*+(?::\s*+(?:\{[^}]*\}\s*+)?[^={;]*+)?=>")


@dataclass
class Function:
    """A named function: the start of its line, the end of its signature and the end of its body."""

    name: str
    start: int
    signature_end: int
    end: int


def _body_end(code: str, brace: int) -> int:
    end = closing(code, brace)
    return len(code) if end < 0 else end + 1


def functions(s: Scan, language: str) -> list[Function]:
    """All named functions and methods with a body, also those assigned to a name."""
    code, found = s.code, []
    for m in _DEFS[language].finditer(code):
        name = m.group("name")
        if name in _NOT_NAMES:
            continue
        if language == "ruby":
            found.append(Function(name, m.start(), m.end(), _ruby_end(code, m)))
            continue
        close = closing(code, m.start("p"))
        if close < 0:
            continue
        if language == "python":
            colon = re.compile(r"\s*+(?:->[^:\n]*+)?:").match(code, close + 1)
            if colon:
                found.append(Function(name, m.start(), colon.end(), _python_end(code, m.end("lead") - m.start("lead"), colon.end())))
            continue
        if language in ("go", "rust", "php"):
            brace = re.compile(r"[^;{]*+\{" if language != "go" else r"[^\n;{]*+\{").match(code, close + 1)
        else:
            brace = _PARAMS_THEN[language].match(code, close + 1)
            words = code[m.start() : m.start("name")].split()
            if brace and language in ("java", "c") and words and words[-1].strip("*&") in ("return", "new", "else", "throw", "case", "goto", "delete"):
                continue
            if brace and language == "java" and not words:
                continue
        if brace:
            found.append(Function(name, m.start(), brace.end() - 1, _body_end(code, brace.end() - 1)))
    for m in _ASSIGNED[language].finditer(code):
        name = m.group("name") or m.groupdict().get("name2")
        at = m.end()
        if language in ("javascript", "typescript"):
            if m.group("bare") is None:
                if code[at : at + 1] == "<":
                    at = code.find("(", at)
                    if at < 0:
                        continue
                close = closing(code, at)
                if close < 0:
                    continue
                at = close + 1
                if not re.search(r"function\b[^=]*$", code[m.start() : m.end()]):
                    arrow = _ARROW.match(code, at)
                    if not arrow:
                        continue
                    at = arrow.end()
                else:
                    brace = _PARAMS_THEN[language].match(code, at)
                    if not brace:
                        continue
                    at = brace.end() - 1
        brace = code.find("{", at)
        end = _body_end(code, brace) if brace >= 0 and not code[at:brace].strip(" \t\n") else (code.find("\n", at) if code.find("\n", at) >= 0 else len(code))
        found.append(Function(name, m.start(), at, end))
    seen: set[tuple[str, int]] = set()
    unique = []
    for f in sorted(found, key=lambda f: f.start):
        if (f.name, f.start) not in seen:
            seen.add((f.name, f.start))
            unique.append(f)
    return unique


def _python_end(code: str, indent: int, at: int) -> int:
    """End of an indented block that follows a signature."""
    for line in re.compile(r"^[ \t]*(?=\S)", re.M).finditer(code, code.find("\n", at) + 1 or len(code)):
        if line.end() - line.start() <= indent:
            return line.start()
    return len(code)


def _ruby_end(code: str, m: re.Match) -> int:
    closed = re.compile(rf"^{m.group('lead')}end\b", re.M).search(code, m.end())
    return closed.end() if closed else len(code)


_STEP = {
    "java": re.compile(r"^[ \t]*@\w[\w.]*[ \t]*(?:\(.*\))?[ \t]*$"),
    "javascript": re.compile(r"^[ \t]*@[\w.]+[ \t]*(?:\(.*\))?[ \t]*$"),
    "rust": re.compile(r"^[ \t]*#!?\[.*\][ \t]*$"),
    "php": re.compile(r"^[ \t]*#\[.*\][ \t]*$"),
    "c": re.compile(r"^[ \t]*(?:\[\[.*\]\]|template[ \t]*<.*>|__attribute__[ \t]*\(.*\))[ \t]*$"),
}
_STEP["typescript"] = _STEP["javascript"]


def documentation(s: Scan, f: Function, language: str) -> str | None:
    """The raw text that documents ``f``: a Python docstring, elsewhere the comment right above."""
    if language == "python":
        for start, end in s.strings:
            if start >= f.signature_end:
                between = s.code[f.signature_end : start]
                return s.text[start:end] if not between.strip(" \t\r\n\\" + COMMENT) else None
        return None
    line = s.text.rfind("\n", 0, f.start) + 1 if f.start else 0
    step = _STEP.get(language)
    while step and line > 0:
        above = s.text.rfind("\n", 0, line - 1) + 1
        shown = s.code[above : line - 1]
        if shown.strip(" \t\r" + COMMENT) and step.match(s.text[above : line - 1]):
            line = above
            continue
        multi = re.compile(r"[ \t]*@[\w.]+\s*\(").match(s.code, _annotation_start(s.code, line)) if shown.strip().endswith(")") else None
        if multi:
            line = multi.start()
            continue
        break
    if line <= 0:
        return None
    end_of_above = line - 1
    taken: list[str] = []
    for start, end in reversed(s.comments):
        if start >= end_of_above:
            continue
        tail = s.text[end:end_of_above]
        if tail.strip(" \t\r") or end < s.text.rfind("\n", 0, end_of_above) + 1 and s.text[end - 1 : end] != "\n":
            break
        begin = s.text.rfind("\n", 0, start) + 1
        if s.text[begin:start].strip():
            break
        block = s.text[start : start + 2] == "/*" or s.text.startswith("=begin", start)
        if block and taken:
            break
        taken.append(s.text[start:end])
        if block or begin == 0:
            break
        end_of_above = begin - 1
    return "\n".join(reversed(taken)) if taken else None


def _annotation_start(code: str, line: int) -> int:
    """Start of the line on which the bracket opens that closes at the end of the line above."""
    depth, at = 0, len(code[:line].rstrip()) - 1
    while at >= 0:
        if code[at] == ")":
            depth += 1
        elif code[at] == "(":
            depth -= 1
            if not depth:
                break
        at -= 1
    return code.rfind("\n", 0, max(at, 0)) + 1
