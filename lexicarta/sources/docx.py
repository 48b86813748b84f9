"""Blocks of a word-processor document, read from its zipped XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

BLOCKS = "idx int, kind string, style string, text string, cells array<array<string>>, has_image boolean"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            parts.append(x.text or "")
        elif x.tag == f"{_W}tab":
            parts.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
    return "".join(parts)


def blocks(content: bytes) -> list[dict]:
    """Paragraphs and tables of the body in order; raises what a broken file raises."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                if name is not None:
                    names[style.get(f"{_W}styleId")] = _style_name(name.get(f"{_W}val", ""))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    found = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else None
            found.append({"kind": "paragraph", "style": names.get(key, key) or "Normal", "text": _text(node), "cells": None, "has_image": next(node.iter(_BLIP), None) is not None})
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(_text(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            found.append({"kind": "table", "style": None, "text": None, "cells": rows, "has_image": False})
    return [{"idx": i, **block} for i, block in enumerate(found)]


def _style_name(name: str) -> str:
    return name.title() if name.lower().startswith(("heading", "title", "subtitle")) else name
