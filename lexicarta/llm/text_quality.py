"""Figures of each text, and how much of it is running prose.

A text is cut into segments: runs of lines that are plain or that are split into cells. Four
distributions of each segment are compared with profiles by Jensen-Shannon divergence:
character classes, the lengths in words of the units that lines, cells or wrapped paragraphs make,
determiners, other function words and content words of the segment's language, and whether a function word follows a determiner. The
nearest profile is the segment's kind, and the kind of most characters that of the text.

The profiles are learned from all documents: prose has one for each language of the given common
words, the other structures one for all. Fixed seeds only name the structures and start the fit. A first pass counts what follows the common
words, a second keeps each document's figures and its segments' counts, on which the rounds of the fit and the judgement run.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache, cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicarta.runtime import cut, spread

WORD = re.compile(r"[^\W_]+")

KINDS = ("prose", "list", "table", "encoded", "scrambled", "words", "symbols")
#: Fixed values, from which the fit starts: letters, digits, sentence marks, other symbols | units of 1-3 words, of 4 to a sentence's least, longer |
#: determiners, other function words, content words | content word, function word after a determiner.
SEEDS = np.array(
    [
        [0.95, 0.02, 0.03, 0.00, 0.0, 0.1, 0.9, 0.2, 0.2, 0.6, 0.95, 0.05],
        [0.95, 0.02, 0.03, 0.00, 0.2, 0.7, 0.1, 0.1, 0.2, 0.7, 0.95, 0.05],
        [0.70, 0.20, 0.05, 0.05, 0.9, 0.1, 0.0, 0.05, 0.05, 0.9, 0.95, 0.05],
        [0.50, 0.45, 0.00, 0.05, 0.3, 0.2, 0.5, 0.0, 0.0, 1.0, 0.95, 0.05],
        [0.95, 0.02, 0.03, 0.00, 0.0, 0.1, 0.9, 0.2, 0.2, 0.6, 0.6, 0.4],
        [0.95, 0.02, 0.03, 0.00, 0.0, 0.1, 0.9, 0.0, 0.0, 1.0, 0.95, 0.05],
        [0.25, 0.05, 0.30, 0.40, 0.3, 0.3, 0.4, 0.0, 0.1, 0.9, 0.95, 0.05],
    ]
)
_PARTS = (slice(0, 4), slice(4, 7), slice(7, 10), slice(10, 12))
_WEIGHTS = (1.0, 1.0, 1.0, 1.0)
#: A segment's followers of determiners count as its language's usual ones until so many were seen.
_PRIOR = 4.0
#: Parts of a character in which the fit's sums count.
_UNIT = 1 << 20
#: About so many characters are scanned at once.
_BLOCK = 1 << 20
#: A function word is a determiner if function words follow it at most this share of what chance would give.
RARE = 0.35


@dataclass(frozen=True)
class Profiles:
    """``words`` and ``determiners`` by language, the usual share of function words after determiners, and profiles of prose by language and of all else."""

    languages: tuple[str, ...]
    words: tuple[frozenset[str], ...]
    determiners: tuple[frozenset[str], ...]
    followed: tuple[float, ...]
    prose: np.ndarray
    other: np.ndarray

    @staticmethod
    def start(words: dict[str, Iterable[str]], followers: Iterable[tuple[str, str, int, int, int]] = ()) -> Profiles:
        """Before the fit. ``followers``: language, function word, how often it was seen inside a line, how often with a function word after it, and words seen."""
        names = tuple(sorted(words)) or ("",)
        sets = tuple(frozenset(w.lower() for w in words.get(n, ())) for n in names)
        seen = list(followers)
        chosen, usual = [], []
        for name, known in zip(names, sets):
            rows = [r for r in seen if r[0] == name and r[1] in known]
            share = sum(r[2] for r in rows) / max(1, *[r[4] for r in seen if r[0] == name], 1)
            those = [r for r in rows if r[2] >= 20 and r[3] / r[2] <= RARE * share]
            chosen.append(frozenset(r[1] for r in those))
            usual.append(sum(r[3] for r in those) / max(1, sum(r[2] for r in those)) if those else 0.05)
        return Profiles(names, sets, tuple(chosen), tuple(usual), np.tile(SEEDS[0], (len(names), 1)), SEEDS[1:].copy())

    @cached_property
    def _index(self) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the common words; where the languages of each number begin, those languages and whether the word is a determiner there."""
        numbers: dict[str, int] = {}
        pairs = sorted((numbers.setdefault(w, len(numbers)), i, w in self.determiners[i]) for i, known in enumerate(self.words) for w in known)
        number, language, first = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        return numbers, np.searchsorted(number, np.arange(len(numbers) + 1)), language, first.astype(bool)

    def numbered(self, words: list[str]) -> np.ndarray:
        """The numbers of ``words``, -1 for what isn't a common word of any language."""
        return np.fromiter(map(self._index[0].get, words, repeat(-1)), np.int64, len(words))

    def spoken(self, numbers: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the language with most common words among its words, the first of equals; of each word whether it is a common one and a determiner of its text's language.

        ``numbers`` are those of the words of all texts, ``owner`` the text of each.
        """
        _, begins, languages, first = self._index
        hits = np.flatnonzero(numbers >= 0)
        listed = numbers[hits]
        times = begins[listed + 1] - begins[listed]
        pair = np.repeat(begins[listed] - np.cumsum(times) + times, times) + np.arange(times.sum())
        word = np.repeat(hits, times)
        votes = np.bincount(owner[word] * len(self.words) + languages[pair], minlength=texts * len(self.words))
        language = votes.reshape(texts, len(self.words)).argmax(1)
        known, lead = np.zeros((2, len(numbers)), dtype=bool)
        mine = languages[pair] == language[owner[word]]
        known[word[mine]] = True
        lead[word[mine & first[pair]]] = True
        return language, known, lead

    def every_word(self) -> frozenset[str]:
        """The common words of all languages."""
        return frozenset().union(*self.words)

    def distances(self, x: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Divergence of each row of ``x`` from its language's prose and from each other structure."""
        found = np.empty((len(x), 1 + len(self.other)))
        for i in range(len(self.prose)):
            mine = language == i
            if mine.any():
                profiles = np.concatenate([self.prose[i : i + 1], self.other])
                found[mine] = sum(w * _divergence(_shares(x[mine][:, part]), _shares(profiles[:, part])) for part, w in zip(_PARTS, _WEIGHTS)).T
        return found

    def expanded(self, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """The four distributions of segments from their whole counts: the usual followers of their language's determiners are added."""
        x, usual = counts.astype(float), np.asarray(self.followed)[language]
        x[:, 10] = counts[:, 10] - counts[:, 11] + _PRIOR * (1 - usual)
        x[:, 11] = counts[:, 11] + _PRIOR * usual
        return x

    def sums(self, x: np.ndarray, language: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the segments nearest to each profile, prose by language first, the sums by size of their shares and of their sizes.

        The sums are of whole numbers, so that they are the same in whatever order and parts they are added.
        """
        kind = self.distances(x, language).argmin(1)
        slot = np.where(kind == 0, language, len(self.prose) + kind - 1)
        shares = np.concatenate([_shares(x[:, part]) for part in _PARTS] + [np.ones((len(x), 1))], axis=1)
        weighted = np.rint(shares * (sizes.astype(float) * _UNIT)[:, None])
        slots = len(self.prose) + len(self.other)
        return np.stack([np.bincount(slot, column, slots) for column in weighted.T], axis=1).astype(np.int64)

    def moved(self, sums: np.ndarray, prior: float = 2000.0) -> Profiles:
        """Profiles at the mean of their segments; ``prior`` characters keep them where they were first."""
        sums = sums / _UNIT
        mean = lambda total, first: (total[..., :-1] + prior * first) / (total[..., -1:] + prior)
        every = mean(sums[: len(self.prose)].sum(0), SEEDS[0])
        return replace(self, prose=mean(sums[: len(self.prose)], every), other=mean(sums[len(self.prose) :], SEEDS[1:]))


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), 1e-9)


_TAGS = re.compile(r"<(/?)(td|th|tr|li|p|br|div|h[1-6]|table|ul|ol|pre)\b[^<>]*>|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_BULLET = re.compile(r"^\s*(?:[-*•·–+]|\(?\d{1,3}(?:\.\d+)*[.)]|\[[ xX]?\]|#+)\s+")
_KEY = re.compile(r"^\s*[\w-]+(?: [\w-]+)?\s*[:=]\s+(?=\S)")
_LEADER = re.compile(r"\.{4,}|_{2,}|\s-{2,}\s|\[ \]|\bn/a\b")
_GAP = re.compile(r" {3,}")
_WIDE = re.compile(r"\t| {2,}")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_INNER = re.compile(r"[a-zß-ÿ)][.!?][\"'»”’)]* +[A-ZÀ-Þ0-9]")
_MARKS = (".", "!", "?", "…")
_CLOSERS = "\"'»”’)]"

_CLASSES = bytearray(b"s" * 256)
for _c in range(256):
    if chr(_c).isalpha() and _c < 128 or _c >= 128:
        _CLASSES[_c] = ord("l")
    elif 48 <= _c <= 57:
        _CLASSES[_c] = ord("d")
    elif chr(_c) in ".,;:!?'\"()-":
        _CLASSES[_c] = ord("p")
_CLASSES = bytes(_CLASSES)
_BLANK = b" \t\r\n\x0b\x0c"


@cache
def _signs() -> np.ndarray:
    """Of each code point whether it is part of a word (1) and whether it is visible (2)."""
    every = np.arange(sys.maxunicode + 1, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    word, blank = (np.fromiter(map(test, every), bool, len(every)) for test in (str.isalnum, str.isspace))
    return word | ~blank * np.uint8(2)


class _Scan:
    """Texts as one array of code points with a line break after each."""

    def __init__(self, texts: list[str]) -> None:
        self.code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        self.signs = _signs()[self.code]
        self.bounds = np.cumsum([0, *map(len, texts)]) + np.arange(len(texts) + 1)

    def _each(self, marks: np.ndarray) -> np.ndarray:
        """How many code points of each text, its line break with it, are marked."""
        return np.diff(np.searchsorted(np.flatnonzero(marks), self.bounds))

    def n_words(self) -> np.ndarray:
        inner = self.signs & 1
        inner[1:] &= ~self.signs[:-1]  # what follows a part of a word begins none
        return self._each(inner)

    def letters(self) -> np.ndarray:
        """The characters in words of each text."""
        return np.diff(self.bounds) - self._each(self.signs & 1 == 0)

    def visible(self) -> np.ndarray:
        return np.diff(self.bounds) - self._each(self.signs & 2 == 0)

    def words(self) -> list[str]:
        """All words in lower case, one text after the other."""
        return np.where(self.signs & 1, self.code, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").lower().split()

    def odd(self) -> bool:
        """Is there a letter whose lower case has another length or depends on what is around its word?"""
        return bool(((self.code == 0x130) | (self.code == 0x3A3)).any())


def _lowered(texts: list[str], scan: _Scan | None = None) -> tuple[list[str], np.ndarray]:
    """The words of the texts in lower case and how many each has."""
    scan = scan or _Scan(texts)
    if scan.odd():
        scan = _Scan([text.lower() for text in texts])
    return scan.words(), scan.n_words()


def _blocks(items: Iterable[tuple], languages: int) -> Iterator[list[tuple]]:
    """Parts of ``items``, which begin with a text, of about ``_BLOCK`` characters and counts of languages."""
    block, held = [], 0
    for item in items:
        block.append(item)
        held += len(item[0]) + languages
        if held >= _BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def _ended(line: str) -> bool:
    """Does a line end in a sentence mark, with closing marks and blanks after it or not?"""
    line = line.rstrip()
    return line.endswith(_MARKS) or line.rstrip(_CLOSERS).endswith(_MARKS)


def _tag(m: re.Match) -> str:
    name = (m.group(2) or "").lower()
    if name in ("td", "th"):
        return "\t"
    return "\n" if name in ("tr", "li", "br", "p") and (m.group(1) or name == "br") else " "


def _cells(line: str) -> list[str] | None:
    """The cells of a line that is a row of a table, form or contents list; None for a plain line."""
    if line.count("|") >= 2 or " > " in line and line.count(" > ") >= 2:
        return re.split(r"\||\s>\s", line)
    for cells in (line.split("\t") if "\t" in line else (), _GAP.split(line.strip()) if "   " in line else ()):
        if len(cells) >= 3 or len(cells) == 2 and len(line) < 60:
            words = len(WORD.findall(line))
            if words <= 3.2 * len(cells):
                return list(cells)
    tight = line.count(",") - line.count(", ")
    if tight >= 2 and 2 * tight > line.count(","):
        return line.split(",")
    if ("...." in line or "__" in line or "--" in line or "[ ]" in line or "n/a" in line) and _LEADER.search(line):
        return _LEADER.split(line)
    return None


def _runs_on(line: str, following: str, common: frozenset[str]) -> bool:
    """Does a sentence go on from one line to the next? A line that ends in a function word or comma has no end of its own."""
    if _BULLET.match(following):
        return False
    return line.endswith(",") or line.rpartition(" ")[2].lower() in common


def _segments(text: str, common: frozenset[str]) -> Iterator[tuple[str, list[str], list[int], bool]]:
    """Each segment's text; the texts of its units, cut at keys; which of these are keys; and whether a lone sentence could end it."""
    if "<" in text:
        text = _TAGS.sub(_tag, text)
    block: list[tuple[str, list[str] | None]] = []
    kind = None

    def flush() -> tuple[str, list[str], list[int], bool]:
        lines = [line for line, _ in block]
        whole = "\n".join(lines)
        if kind:
            return whole, [cell for line, cells in block for cell in cells or _WIDE.split(line)], [], False
        if len(lines) > 1:
            lines = [line for line in lines if WORD.search(line)]
        if len(lines) > 1:
            trimmed = [" ".join(line.lstrip("> \t").split()) or " " for line in lines]
            items = sum(bool(_BULLET.match(line) or _KEY.match(line)) for line in lines)
            if items < 0.5 * len(lines) and (_wrapped(trimmed) or sum(_runs_on(a, b, common) for a, b in zip(trimmed, trimmed[1:])) + len(_INNER.findall(whole)) >= 0.25 * len(lines)):
                lines = [" ".join(trimmed)]
        units, keys = [], []
        for line in lines:
            if len(lines) > 2 and (key := _KEY.match(line)):
                keys.append(len(units))
                units.append(key.group())
            bullet = _BULLET.match(line)
            units.append(line[bullet.end() :] if bullet else line)
        return whole, units, keys, _ended(whole)

    for paragraph in _PARAGRAPH.split(text):
        lines = [line for line in paragraph.split("\n") if line and not line.isspace()]
        cells = [_cells(line) for line in lines]
        rows = [c is not None for c in cells]
        if len(lines) > 2 and 0.4 * len(lines) <= sum(rows) < len(lines):
            rows = [row or "  " in line.strip() or "\t" in line for row, line in zip(rows, lines)]
        for row, line in zip(rows, zip(lines, cells)):
            if block and row != kind:
                yield flush()
                block = []
            kind = row
            block.append(line)
        if block:
            yield flush()
        block = []


def _wrapped(lines: list[str]) -> bool:
    """Were the lines broken at a width, in the middle of sentences?"""
    widths = sorted(map(len, lines))
    width = max(w for w in widths if w <= 2 * widths[len(widths) // 2])
    if width < 46:
        return False
    low = sum(line[0].islower() or line[0].isdigit() for line in lines[1:])
    full = sum(len(a) + 1 + len(b.split(" ", 1)[0]) > 0.88 * width for a, b in zip(lines, lines[1:]))
    return full >= 0.6 * (len(lines) - 1) and low >= 0.2 * (len(lines) - 1)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``q``, one a row, from each row of ``p``."""
    both = _entropy((b[:, None] + a) / 2 for a, b in zip(p.T, q.T))
    return both - (_entropy(p.T) + _entropy(q.T)[:, None]) / 2


def _entropy(shares: Iterable[np.ndarray]) -> np.ndarray:
    return -sum(x * np.log2(np.where(x > 0, x, 1)) for x in shares)


def _units(found: list[tuple[str, list[str], list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths in words of all units of segments and the segment of each; pieces without a word are none."""
    pieces = [piece for _, units, _, _ in found for piece in units]
    many = np.array([len(units) for _, units, _, _ in found])
    n = _Scan(pieces).n_words()
    keep = n > 0
    keys = np.array([first + k for first, (_, _, keys, _) in zip(np.cumsum(many) - many, found) for k in keys], dtype=np.int64)
    keep[keys + 1] = True
    keep[keys] = apart = n[keys + 1] > n[keys]  # else the key is all there is
    n[keys + 1] -= np.where(apart, n[keys], 0)
    return n[keep], np.repeat(np.arange(len(found)), many)[keep]


def _features(found: list[tuple[str, list[str], list[int], bool]], p: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole counts of segments (``Profiles.expanded``), their languages, those with most common words in them, and their sizes."""
    texts, many = [segment[0] for segment in found], len(found)
    scan = _Scan(texts)
    words, n_words = _lowered(texts, scan)
    owner = np.repeat(np.arange(many), n_words)
    language, known, lead = p.spoken(p.numbered(words), owner, many)
    each = lambda owners, weights=None: np.bincount(owners, weights, many).astype(np.int64)
    common, leads = each(owner[known]), each(owner[lead])
    led = np.flatnonzero(lead[:-1] & (owner[:-1] == owner[1:])) + 1
    units, of = _units(found)
    n_units, total = each(of), each(of, units)
    small = each(of, np.where(units <= 3, units, 0))
    large = each(of, np.where(units >= np.where(n_units > 2, 10, 8)[of], units, 0))
    lone = (n_units == 1) & (total >= 5) & np.array([segment[3] for segment in found]) & (common > 0)
    small, large = np.where(lone, 0, small), np.where(lone, total, large)
    classes = [text.encode("utf-8", "replace").translate(_CLASSES, _BLANK) for text in texts]
    counts = np.stack(
        [
            *np.array([[c.count(b"l"), c.count(b"d"), c.count(b"p"), c.count(b"s")] for c in classes], dtype=np.int64).T,
            np.where(total == 0, 1, small), total - small - large, large,
            leads, common - leads, np.maximum(n_words - common, n_words == 0), each(owner[led]), each(owner[led[known[led]]]),
        ],
        axis=1,
    )
    return counts, language, scan.visible()


def segments(texts: list[str | None], p: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments of a batch of texts the whole counts, language, size and text."""
    every, owner = p.every_word(), []

    def found() -> Iterator[tuple[str, list[str], list[int], bool]]:
        for i, text in enumerate(texts):
            if text and not text.isspace():
                for segment in _segments(text, every):
                    owner.append(i)
                    yield segment

    none = (np.empty((0, SEEDS.shape[1]), dtype=np.int64), *np.empty((2, 0), dtype=np.int64))
    parts = [none, *(_features(block, p) for block in _blocks(found(), len(p.words)))]
    return *map(np.concatenate, zip(*parts)), np.array(owner, dtype=np.int64)


FIGURES = ("n_words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", "visible")


def _figures(texts: list[str | None], p: Profiles) -> np.ndarray:
    """``FIGURES`` of each text."""
    figures = np.zeros((len(texts), len(FIGURES)))
    for block in _blocks(((text, i) for i, text in enumerate(texts) if text and not text.isspace()), 0):
        those = [text for text, _ in block]
        scan, ended = _Scan(those), np.zeros((len(block), 2), dtype=np.int64)
        for k, text in enumerate(those):
            lines = [line for line in map(str.rstrip, text.split("\n")) if line]
            ended[k] = sum(map(_ended, lines)), len(lines)
        n_words, letters, visible = scan.n_words(), scan.letters(), scan.visible()
        owner = np.repeat(np.arange(len(block)), n_words)
        common = np.bincount(owner[p.numbered(scan.words()) >= 0], minlength=len(block))
        some = np.maximum(1, n_words)
        figures[[i for _, i in block]] = np.stack([n_words, letters / some, (visible - letters) / visible, ended[:, 0] / ended[:, 1], common / some, visible], axis=1)
    return figures


def _judged(visible: np.ndarray, counts: np.ndarray, language: np.ndarray, sizes: np.ndarray, owner: np.ndarray, p: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the share of prose in its visible characters and the kind of most of them, -1 where there are none."""
    share = np.zeros((len(visible), len(KINDS)))
    if len(counts):
        np.add.at(share, (owner, p.distances(p.expanded(counts, language), language).argmin(1)), sizes)
    return np.minimum(1.0, share[:, 0] / np.maximum(visible, 1)), np.where(visible > 0, share.argmax(1), -1)


def assess(texts: list[str | None], p: Profiles) -> dict[str, np.ndarray]:
    """Figures of each text of a batch, by name."""
    figures = dict(zip(FIGURES, _figures(texts, p).T))
    prose, kind = _judged(figures.pop("visible"), *segments(texts, p), p)
    return figures | {"n_words": figures["n_words"].astype(np.int64), "prose_share": prose, "kind": kind}


SCHEMA = "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, prose_share double, kind string"


def _followers(p: Profiles):
    """How often each common word is seen, and with a common word of its language after it, in lines of that language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("seen", pa.int64()), ("followed", pa.int64()), ("words", pa.int64())])
    names = np.array(p.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.array([*p._index[0], ""], dtype=object)
        for batch in batches:
            for block in _blocks(((text,) for text in batch.column(0).to_pylist() if text), len(names)):
                words, n_words = _lowered([text for (text,) in block])
                owner = np.repeat(np.arange(len(block)), n_words)
                numbers = p.numbered(words)
                language, known, _ = p.spoken(numbers, owner, len(block))
                at = np.flatnonzero(known[:-1] & (owner[:-1] == owner[1:]))
                pairs, place, seen = np.unique(language[owner[at]] * len(common) + numbers[at], return_inverse=True, return_counts=True)
                followed = np.bincount(place, known[at + 1], len(pairs)).astype(np.int64)
                total = np.bincount(language, n_words, len(names)).astype(np.int64)
                spoken = np.flatnonzero(total)
                zeros = np.zeros(len(spoken), dtype=np.int64)
                lang, word = np.divmod(np.concatenate([pairs, spoken * len(common) + len(common) - 1]), len(common))
                counts = [seen, zeros], [followed, zeros], [np.zeros(len(pairs), dtype=np.int64), total[spoken]]
                yield pa.RecordBatch.from_arrays([pa.array(names[lang], pa.string()), pa.array(common[word], pa.string()), *(pa.array(np.concatenate(c)) for c in counts)], schema=schema)

    return run


_LISTS = ("counts", "language", "sizes")
_MEASURED = "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, visible bigint, counts array<int>, language array<int>, sizes array<int>"


def _measure(p: Profiles):
    """Of each text its figures and the counts of its segments one after the other."""
    names = [column.split()[0] for column in _MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            figures = dict(zip(FIGURES, _figures(texts, p).T))
            figures |= {c: figures[c].astype(np.int64) for c in ("n_words", "visible")}
            counts, language, sizes, owner = segments(texts, p)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends * width), pa.array(values.ravel().astype(np.int32))) for values, width in ((counts, counts.shape[1]), (language, 1), (sizes, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(figures[c]) for c in FIGURES), *lists], names=names)

    return run


def _measured(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """What ``segments`` gave, from the lists of a batch."""
    counts, language, sizes = (batch.column(batch.schema.get_field_index(c)) for c in _LISTS)
    owner = np.repeat(np.arange(batch.num_rows), language.value_lengths().to_numpy())
    return counts.flatten().to_numpy().reshape(-1, SEEDS.shape[1]), language.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64), owner


def _added(p: Profiles):
    """A task's ``Profiles.sums``, each other than 0 a row."""
    schema = pa.schema([("slot", pa.int64()), ("part", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(p.prose) + len(p.other), SEEDS.shape[1] + 1), dtype=np.int64)
        for batch in batches:
            counts, language, sizes, _ = _measured(batch)
            if len(counts):
                total += p.sums(p.expanded(counts, language), language, sizes)
        slot, part = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(part), pa.array(total[slot, part])], schema=schema)

    return run


def _start(texts: DataFrame, common_words: DataFrame) -> Profiles:
    """Profiles before the fit: the determiners among the common words, by what follows them in all texts."""
    listed = common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct()
    words: dict[str, list[str]] = defaultdict(list)
    rows = listed.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 common words")
    for row in rows:
        words[row["lang"]].append(row["word"])
    seen = texts.select("text").mapInArrow(_followers(Profiles.start(words)), "lang string, word string, seen bigint, followed bigint, words bigint")
    seen = seen.groupBy("lang", "word").agg(F.sum("seen"), F.sum("followed"), F.sum("words")).collect()  # a row a common word and language
    return Profiles.start(words, sorted(map(tuple, seen)))


def _fit(measured: DataFrame, start: Profiles, rounds: int = 8) -> Profiles:
    """Profiles moved to the mean of the segments nearest to them, by size, some times over; every segment counts."""
    bare = replace(start, words=(), determiners=())
    for _ in range(rounds):
        sums = np.zeros((len(bare.prose) + len(bare.other), SEEDS.shape[1] + 1), dtype=np.int64)
        for slot, part, total in measured.select(*_LISTS).mapInArrow(_added(bare), "slot bigint, part bigint, total bigint").groupBy("slot", "part").agg(F.sum("total")).collect():  # a row a number of the profiles
            sums[slot, part] = total
        if not sums.any():
            break
        before, bare = bare, bare.moved(sums)
        if np.array_equal(before.prose, bare.prose) and np.array_equal(before.other, bare.other):
            break
    return replace(start, prose=bare.prose, other=bare.other)


def _surveyed(texts: DataFrame, common_words: DataFrame) -> tuple[DataFrame, Profiles]:
    """Figures and segments of ``doc_id, text`` and the profiles fitted on them."""
    texts = spread(texts)
    start = _start(texts, common_words)
    measured = cut(texts.mapInArrow(_measure(start), _MEASURED))
    return measured, _fit(measured, start)


def learn(df: DataFrame, text: Column, common_words: DataFrame) -> Profiles:
    """Profiles fitted on all texts.

    ``common_words`` has ``lang, word``, at most 100,000 rows; ValueError beyond. Null and blank texts and words teach nothing.
    """
    return _surveyed(df.select(F.lit(0).cast("bigint").alias("doc_id"), text.cast("string").alias("text")), common_words)[1]


def quality(df: DataFrame, doc_id: Column, text: Column, common_words: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """Figures of every document.

    Columns: ``n_words``; ``mean_word_length``; ``symbol_ratio``, visible characters outside words;
    ``ended_lines``, the share of non-blank lines that end in a sentence mark; ``common_words``, the share of words that
    ``common_words (lang, word)`` lists for any language; ``prose_share``, the share of visible characters in running sentences; and ``kind``, the
    profile nearest to most of the text. Null and blank texts get zeros and a null kind; repeated
    rows are judged each. Other columns aren't read. Without ``profiles`` they are learned from all the texts.
    """
    texts = df.select(doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text"))
    if profiles:
        measured, p = spread(texts).mapInArrow(_measure(profiles), _MEASURED), profiles
    else:
        measured, p = _surveyed(texts, common_words)
    bare = replace(p, words=(), determiners=())
    names = [column.split()[0] for column in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prose, kind = _judged(batch.column(6).to_numpy(), *_measured(batch), bare)
            kinds = pa.array([KINDS[k] if k >= 0 else None for k in kind], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(prose), kinds], names=names)

    return measured.mapInArrow(run, SCHEMA)
