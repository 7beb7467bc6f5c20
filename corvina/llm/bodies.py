"""Main bodies: what is left of a page without its furniture, cut into units and described by statistics.

A unit is a paragraph, with wrapped lines joined, or a list item, table row, heading and so on.  Each unit is of one
kind; the shares of the kinds by characters, and plain statistics of the words, describe the body.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from corvina.llm.layout import Line, ends_sentence

_URL = re.compile(r"(?:https?://|www\.)[^\s)\]]+")
_PRICE = re.compile(r"[€£$¥]\s?\d|\d\s?[€£]|-\d{1,2}%|★|\bin stock\b|\b[A-Z]{2,4}-\d{3,}\b")
_SKU = re.compile(r"★★|\b[A-Z]{2,4}-\d{3,}\b")
_ITEMS = re.compile(r"\s*[·|»;,、，；/・]\s*")
_TAG = re.compile(r"#\w+")
_BULLET = re.compile(r"^(?:[-*+•◦▪‣]|\(?\d{1,3}[.)])\s+")
_CELLS = re.compile(r"\S(?:\s\|\s|\t|\s{3,})\S")
_PAIR = re.compile(r"^[^:]{1,30}:\s*(?:—|-|\d[\d.,]*\s?\w{0,3}|\S{1,20})$")
_WORD = re.compile(r"[ァ-ヺー]+|[ぁ-ゖ]+|[㐀-鿿]+|[^\W\d_ぁ-ゖァ-ヺー㐀-鿿]+(?:['’-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")
_LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INLINE = re.compile(r"(?<!\])\(\s*(?:https?://|www\.)[^)]*\)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile(r"[ぁ-ゖ]")
_STOP = re.compile(r"[.!?]+[\"'”’»)]*(?=\s|$)|[。！？]+[”’」』)）]*")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–—…“”‘’«»„‚。，、；：！？「」『』（）·・¿¡]")
_MOJIBAKE = re.compile(r"[ÃÂÐÑâï¿½€œ™¤§©¶°¼»]")

_HANGUL = re.compile(r"[가-힣]")
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"[+-]?\d+(?:[.:/-]\d+)*%?")
_COMMA = re.compile(r"[,、，;；/・»]")
_SUSPECT = re.compile(r"[|#*@^~\\{}<>=+★\t€£$%ÃÂÐÑ]")

#: A word is a keyword of its body if it isn't common and makes up such a share of the words.
DOMINANT = 0.06

#: Kinds of units.  ROWS are bare short lines one below another, without bullets, numbers or sentences.
PROSE, HEADING, LIST, TABLE, JUNK, LINKS, PRODUCTS, KEYWORDS, ROWS = range(9)
KINDS = 9


# What counts as one word beside words: addresses, article numbers, other numbers; and the words they become.
_MARKED = re.compile(r"(?:https?://|www\.)[^\s)\]]+|\b[A-Z]{2,4}-\d{3,}\b|\d[\d.,:%°]*")
MARKS = ADDRESS, ARTICLE, NUMBER = "aaurl", "aasku", "aanum"


class Unit:
    """A unit: its text, kind, words (lower case), the words with addresses and numbers as one word each, and how many are common."""

    __slots__ = ("text", "kind", "words", "marked", "common", "ended")

    def __init__(self, text: str) -> None:
        self.text, self.kind, self.common, self.ended = text, PROSE, 0, False
        self.words: list[str] = []
        self.marked: list[str] = []


def _mark(found: re.Match) -> str:
    text = found[0]
    return f" {ADDRESS} " if text[0] in "hw" else f" {ARTICLE} " if text[0].isalpha() else f" {NUMBER} "


def paragraphs(lines: Sequence[Line], furniture: Sequence[bool]) -> list[str]:
    """Paragraphs of the main body, wrapped lines joined, in order; the page's own title is left out."""
    out: list[str] = []
    joinable = False
    for line, gone in zip(lines, furniture):
        if gone or line.kind in ("blank", "title"):
            joinable = False
            continue
        if joinable and line.inner and not _BULLET.match(line.text) and "|" not in line.text and not _URL.match(line.text):
            out[-1] += " " + line.text
        else:
            out.append(line.text)
        joinable = not ends_sentence(line.text) and len(line.text) >= 50
    return out


def units(parts: Sequence[str], cut: Sequence[list[str]] | None = None) -> list[Unit]:
    """Units of a body given as paragraphs; addresses in parentheses behind a sentence are left out.  ``cut`` holds the paragraphs' pieces."""
    cut = list(map(pieces, parts)) if cut is None else cut
    return [Unit(piece) for part, known in zip(parts, cut) for piece in (pieces(_INLINE.sub("", part)) if "://" in part or "www." in part else known) if piece]


def tokens(text: str) -> list[str]:
    """Lower-cased words.  Korean words are cut to their first two syllables, Japanese is cut where its scripts change, and Chinese (Han letters without kana) into pairs of characters."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    if not _EAST.search(text):
        return _LATIN_WORD.findall(text.lower())
    if _HANGUL.search(text):
        found = _WORD.findall(text.lower()) if _CJK.search(text) else _LATIN_WORD.findall(text.lower())
        return [w[:2] if "가" <= w[0] <= "힣" else w for w in found]
    found = _WORD.findall(text.lower())
    if _KANA.search(text):
        return found
    out = []
    for w in found:
        if "㐀" <= w[0] <= "鿿" and len(w) > 2:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def pieces(text: str) -> list[str]:
    """A long unit cut behind its sentences (texts without line breaks come as one unit); others whole."""
    if len(text) <= 200:
        return [text]
    out, last = [], 0
    for found in _STOP.finditer(text):
        if found.end() - last >= 60:
            out.append(text[last : found.end()].strip())
            last = found.end()
    if text[last:].strip():
        out.append(text[last:].strip())
    return out or [text]


def describe(parts: list[Unit], common: frozenset[str]) -> Counter:
    """Set the words and the kind of every unit; returns the counts of the words.

    A word that isn't common and recurs far more than a text needs is a keyword of the body; a unit that is mostly made
    of them is stuffed even where it is punctuated like prose.
    """
    for unit in parts:
        if _DIGIT.search(unit.text) or "://" in unit.text or "www." in unit.text:
            unit.marked = tokens(_MARKED.sub(_mark, unit.text))
            unit.words = [w for w in unit.marked if w not in MARKS]
        else:
            unit.words = unit.marked = tokens(unit.text)
        unit.common = sum([w in common for w in unit.words])
        unit.ended = ends_sentence(unit.text)
    counts = Counter([w for unit in parts for w in unit.words])
    dominant = keywords(counts, DOMINANT, common)
    for unit in parts:
        unit.kind = _kind(unit, dominant)
    for i, unit in enumerate(parts):
        if unit.kind == HEADING:
            near = [parts[k].kind for k in (i - 1, i + 1) if 0 <= k < len(parts)]
            # A heading stands by itself; rows of such lines are a list.
            if near and all(k in _ROWED for k in near):
                unit.kind = LIST if _DIGIT.search(unit.text) or _BULLET.match(unit.text) else ROWS
    return counts


def keywords(counts: Counter, share: float, common: frozenset[str]) -> set[str]:
    """The words that aren't common and make up such a share of all words."""
    least = max(4, share * sum(counts.values()))
    return {w for w, n in counts.items() if n >= least and len(w) > 1 and w not in common and not "ぁ" <= w[0] <= "ゖ"}


#: Kinds that may stand above and below a bare line of a list.
_ROWED = (HEADING, KEYWORDS, LIST, PRODUCTS, LINKS, ROWS)


def _kind(unit: Unit, dominant: set[str]) -> int:
    text, words, ended = unit.text, unit.words, unit.ended
    size = len(text)
    share = unit.common / len(words) if words else 0.0
    stuffed = len(words) >= 2 and bool(dominant) and sum([w in dominant for w in words]) >= (0.24 if ended else 0.4) * len(words)
    spaced = text.isascii() or not _CJK.search(text)
    if ended and not stuffed and size >= 40 and (share >= 0.15 if spaced else len(_SYMBOL.findall(text)) <= 0.2 * size) and not _SUSPECT.search(text) and "://" not in text and "www." not in text:
        return PROSE
    hangul = spaced and _HANGUL.search(text) is not None
    if "www." in text or "://" in text:
        url = sum(map(len, _URL.findall(text)))
        rest = _URL.sub(" ", text)
        if url * 2 > size or (len(rest) <= 80 and not ended):
            return LINKS
    if len(_MOJIBAKE.findall(text)) > 0.3 * size:
        return JUNK
    if not ended and _is_record(text):
        return TABLE
    tags = _TAG.findall(text) if "#" in text else ()
    if len(tags) >= 3 and sum(map(len, tags)) * 2 > size:
        return KEYWORDS
    if not ended and text[0] != "|" and not _DIGIT.search(text):
        items = _ITEMS.split(text.strip(" ·|»"))
        if len(items) >= 6 and size / len(items) <= (28 if spaced else 14):
            return KEYWORDS
    odd = len(_SYMBOL.findall(text))
    price = _PRICE.search(text) is not None
    if size >= 8 and odd > 0.2 * size:
        return PRODUCTS if _SKU.search(text) and odd < 0.3 * size else JUNK
    if spaced and not hangul and size > 45 and max(map(len, text.split())) > 45 and "://" not in text:
        return JUNK
    if price and not ended:
        return PRODUCTS
    bars = text.count("|")
    if text[0] == "|" or bars >= 2 and bars * 40 > size or "\t" in text or len(_CELLS.findall(text)) >= 2:
        return TABLE
    if not ended and len(_DIGIT.findall(text)) * 3 > size:
        return TABLE if size < 100 else JUNK
    if not ended:
        if _BULLET.match(text):
            return KEYWORDS if stuffed and size > 60 else LIST
        if size <= 60 and _PAIR.match(text):
            return TABLE
        commas = len(_COMMA.findall(text))
        if commas >= 3 and size / (commas + 1) <= (28 if spaced else 12):
            return KEYWORDS
        if stuffed:
            return KEYWORDS
        if size <= 110 and (not spaced or len(text.split()) <= 14):
            return HEADING
    if size < 90 and _CELLS.search(text):
        return TABLE
    if stuffed:
        return KEYWORDS
    if spaced and not hangul and len(words) >= 6 and share < (0.03 if ended else 0.06):
        return JUNK
    return PROSE


def _is_record(text: str) -> bool:
    """Whether a line is a row of separated data: three or more fields without blanks behind the separator, a third of them numbers."""
    for mark in ",;":
        if text.count(mark) >= 2:
            fields = text.split(mark)
            return not any(f[:1] == " " for f in fields) and sum(_NUMBER.fullmatch(f) is not None for f in fields) * 3 >= len(fields)
    return False


def shares(parts: Sequence[Unit]) -> list[float]:
    """Share of the characters of each kind."""
    out = [0.0] * KINDS
    total = sum(len(u.text) for u in parts)
    if total:
        for u in parts:
            out[u.kind] += len(u.text) / total
    return out


def statistics(text: str, common: frozenset[str]) -> tuple[int, float, float, float, float]:
    """Words, mean word length, symbol ratio, share of non-blank lines ending in punctuation, share of common words.

    Null-safe defaults for a text without words: 0, 0.0, ...  A character of a script without spaces is a word.
    """
    words = _WORD.findall(text.lower())
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    solid = sum(not c.isspace() for c in text)
    if not words:
        return 0, 0.0, len(_SYMBOL.findall(text)) / solid if solid else 0.0, sum(map(ends_sentence, lines)) / len(lines) if lines else 0.0, 0.0
    return (
        len(words),
        sum(map(len, words)) / len(words),
        len(_SYMBOL.findall(text)) / solid,
        sum(map(ends_sentence, lines)) / len(lines),
        sum(w in common for w in words) / len(words),
    )
