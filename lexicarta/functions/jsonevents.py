"""A pull parser for JSON text that hands out events without building the record."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_TOKEN = re.compile(
    r'[ \t\r\n]*(?:"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null)|([{}\[\],:]))'
)
_BLANK = re.compile(r"[ \t\r\n]*")


class Unreadable(ValueError):
    """The text isn't one complete JSON value."""


def events(text: str) -> Iterator[tuple[str, str | None]]:
    """Yield ``(kind, text)`` for one JSON value.

    Kinds: ``{ } [ ]`` open and close containers, ``key`` names a member, ``string``, ``number``,
    ``bool`` and ``null`` are values. A leading byte order mark is skipped.

    Raises:
        Unreadable: the text breaks the grammar or doesn't reach its end.
    """
    at, size = (1 if text[:1] == "﻿" else 0), len(text)
    match = _TOKEN.match
    stack: list[str] = []
    # what may come next: v value, V value or ], k key, K key or }, : colon, , comma or close, $ end
    want = "v"
    while want != "$":
        found = match(text, at)
        if not found:
            raise Unreadable(at)
        at = found.end()
        which = found.lastindex
        if which == 4:
            mark = found.group(4)
            if mark == "{" or mark == "[":
                if want not in "vV":
                    raise Unreadable(at)
                stack.append(mark)
                want = "K" if mark == "{" else "V"
                yield mark, None
                continue
            if mark == "}" or mark == "]":
                opened = stack.pop() if stack else ""
                if mark == "}":
                    if opened != "{" or want not in "K,":
                        raise Unreadable(at)
                elif opened != "[" or want not in "V,":
                    raise Unreadable(at)
                yield mark, None
            elif mark == ",":
                if want != ",":
                    raise Unreadable(at)
                want = "k" if stack[-1] == "{" else "v"
                continue
            else:
                if want != ":":
                    raise Unreadable(at)
                want = "v"
                continue
        elif which == 2:
            if want not in "vV":
                raise Unreadable(at)
            yield "number", found.group(2)
        elif which == 3:
            if want not in "vV":
                raise Unreadable(at)
            word = found.group(3)
            yield ("null", None) if word == "null" else ("bool", word)
        else:
            raw = found.group(0).lstrip(" \t\r\n")
            word = json.loads(raw) if "\\" in raw else raw[1:-1]
            if want in "kK":
                want = ":"
                yield "key", word
                continue
            if want not in "vV":
                raise Unreadable(at)
            yield "string", word
        want = "," if stack else "$"
    if _BLANK.match(text, at).end() != size:
        raise Unreadable(at)
