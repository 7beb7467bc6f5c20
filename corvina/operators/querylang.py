"""The search-query language: validation, lexer and parser to a tree.

Precedence, tightest first: juxtaposition, NOT, AND, OR.  Operators are upper case; lower-case ``and`` is a term.  A
bareword or quoted string of several tokens is a phrase; ``a + b`` joins phrases; ``^a`` must start a column;
``NEAR(a b, k)`` allows k tokens between; ``a*`` is a prefix and ``title:a`` a column filter (both only where allowed).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

MOST_CHARS, MOST_TERMS, MOST_DEPTH = 300, 32, 8


class SearchSyntaxError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; ``columns`` restricts where, ``initial`` to the start of a column, ``prefix`` opens the last token."""

    tokens: tuple[str, ...]
    initial: bool = False
    prefix: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    """An empty phrase: no rows."""


_LATIN = re.compile(r"[^\W\d_]")


def fold(text: str) -> str:
    """Lower case without the accents of Latin letters, as the index folds."""
    out = []
    for char in text.lower():
        base = unicodedata.normalize("NFD", char)
        out.append(base[0] if len(base) > 1 and base[0].isascii() else char)
    return "".join(c for c in out if not "̀" <= c <= "ͯ")


def tokenize(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", fold(text)))


def validate(query: str | None) -> str:
    """The trimmed query, or ``SearchSyntaxError`` if it breaks a rule for public queries."""
    text = (query or "").strip()
    if not text:
        raise SearchSyntaxError("a query is required")
    if len(text) > MOST_CHARS:
        raise SearchSyntaxError(f"a query has at most {MOST_CHARS} characters")
    if any(unicodedata.category(c) == "Cc" for c in text):
        raise SearchSyntaxError("control characters are not allowed")
    if "*" in text or ":" in text:
        raise SearchSyntaxError("prefixes and column filters are not allowed")
    if text.count('"') % 2:
        raise SearchSyntaxError("quotes must be closed")
    depth = 0
    for char in re.sub(r'"[^"]*"', "", text):
        depth += (char == "(") - (char == ")")
        if not 0 <= depth <= MOST_DEPTH:
            raise SearchSyntaxError("parentheses must be balanced and not too deep")
    if depth:
        raise SearchSyntaxError("parentheses must be balanced")
    if not 1 <= len(re.findall(r"[\w\-]+", text)) <= MOST_TERMS:
        raise SearchSyntaxError(f"a query has one to {MOST_TERMS} terms")
    return text


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[^\W]+)|(?P<sign>[()+*^:,{}\-]))')


def lex(query: str) -> list[tuple[str, str]]:
    """(kind, text) of every token; kinds: string, word, and each sign itself."""
    out, at = [], 0
    text = query.rstrip()
    while at < len(text):
        found = _LEX.match(text, at)
        if not found or (found["sign"] in ("-", ",", "{", "}") and not _inside_near(out)):
            raise SearchSyntaxError(f"unexpected character at {at}")
        if found["quoted"] is not None:
            out.append(("string", found["quoted"][1:-1].replace('""', '"')))
        elif found["word"] is not None:
            out.append(("word", found["word"]))
        else:
            out.append((found["sign"], found["sign"]))
        at = found.end()
    return out


def _inside_near(out: list[tuple[str, str]]) -> bool:
    depth = 0
    for kind, text in reversed(out):
        if kind == ")":
            depth += 1
        elif kind == "(":
            if depth == 0:
                i = len(out) - 1 - out[::-1].index((kind, text))
                return i > 0 and out[i - 1] == ("word", "NEAR")
            depth -= 1
    return False


class _Parser:
    def __init__(self, query: str, columns: tuple[str, ...]) -> None:
        self.items, self.at, self.columns = lex(query), 0, columns

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str) -> str:
        if self.peek()[0] != kind:
            raise SearchSyntaxError(f"expected {kind}, found {self.peek()[1] or 'the end'}")
        self.at += 1
        return self.items[self.at - 1][1]

    def is_operator(self, name: str) -> bool:
        return self.peek() == ("word", name)

    def level(self, name: str, below: Callable[[], object], make: type) -> object:
        tree = below()
        while self.is_operator(name):
            self.at += 1
            tree = make(tree, below())
        return tree

    def either(self) -> object:
        return self.level("OR", self.both, Or)

    def both(self) -> object:
        return self.level("AND", self.without, And)

    def without(self) -> object:
        return self.level("NOT", self.sequence, Not)

    def starts(self) -> bool:
        kind, text = self.peek()
        return kind in ("string", "(", "^") or kind == "word" and text not in ("AND", "OR", "NOT")

    def sequence(self) -> object:
        if not self.starts():
            raise SearchSyntaxError(f"unexpected {self.peek()[1] or 'end'}")
        tree = self.primary()
        while self.starts():
            tree = And(tree, self.primary())
        return tree

    def primary(self) -> object:
        if self.peek()[0] == "(":
            self.at += 1
            tree = self.either()
            self.take(")")
            return tree
        if self.is_operator("NEAR") and self.peek(1)[0] == "(":
            self.at += 2
            phrases, distance = [], 10
            while self.peek()[0] in ("word", "string", "^"):
                phrases.append(self.phrase())
            if self.peek()[0] == ",":
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise SearchSyntaxError("NEAR needs a number")
                distance = int(number)
            self.take(")")
            if not phrases:
                raise SearchSyntaxError("NEAR needs a phrase")
            return Near(tuple(p for p in phrases if isinstance(p, Phrase)), distance)
        if self.peek()[0] == "word" and self.peek(1)[0] == ":":
            name = self.take("word")
            self.at += 1
            if name not in self.columns:
                raise SearchSyntaxError(f"no such column: {name}")
            return restrict(self.primary(), name)
        return self.phrase()

    def phrase(self) -> object:
        initial = self.peek()[0] == "^"
        if initial:
            self.at += 1
        tokens: tuple[str, ...] = ()
        while True:
            kind, text = self.peek()
            if kind not in ("word", "string"):
                raise SearchSyntaxError(f"expected a term, found {text or 'the end'}")
            self.at += 1
            tokens += tokenize(text)
            if self.peek()[0] != "+":
                break
            self.at += 1
        prefix = self.peek()[0] == "*"
        if prefix:
            self.at += 1
        return Phrase(tokens, initial, prefix) if tokens else Nothing()


def restrict(tree: object, column: str) -> object:
    """``tree`` with every phrase restricted to one column."""
    if isinstance(tree, Phrase):
        return Phrase(tree.tokens, tree.initial, tree.prefix, (column,))
    if isinstance(tree, Near):
        return Near(tuple(restrict(p, column) for p in tree.phrases), tree.distance)
    if isinstance(tree, Nothing):
        return tree
    return type(tree)(restrict(tree.left, column), restrict(tree.right, column))


def parse(query: str, columns: tuple[str, ...] = ("title", "text")) -> object:
    """The tree of a query; ``SearchSyntaxError`` if it is malformed."""
    parser = _Parser(query, columns)
    if not parser.items:
        raise SearchSyntaxError("empty query")
    tree = parser.either()
    if parser.peek()[0] != "end":
        raise SearchSyntaxError(f"unexpected {parser.peek()[1]}")
    return tree


def phrases(tree: object) -> list[Phrase]:
    """Phrases that can contribute to a match, in order, repeated ones repeated; those behind NOT cannot."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    if isinstance(tree, Nothing):
        return []
    return phrases(tree.left) + ([] if isinstance(tree, Not) else phrases(tree.right))


def terms(tree: object) -> set[tuple[str, bool]]:
    """(token, is a prefix) of every token of a query, those behind NOT too."""
    if isinstance(tree, Phrase):
        return {(t, tree.prefix and i == len(tree.tokens) - 1) for i, t in enumerate(tree.tokens)}
    if isinstance(tree, Near):
        return set().union(*(terms(p) for p in tree.phrases))
    if isinstance(tree, Nothing):
        return set()
    return terms(tree.left) | terms(tree.right)


_WORD = re.compile(r"[^\W_]+")
_HANGUL_WORD = re.compile("[\uac00-\ud7a3]+")
_EAST = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def fallback_tokens(query: str, suffixes: tuple[str, ...]) -> list[str]:
    """One- and two-character n-grams of the Hangul words (stemmed) and of those with kana or Han of a query, each once, in order."""
    out: dict[str, None] = {}
    for word in _WORD.findall(unicodedata.normalize("NFKC", query).lower()):
        if _HANGUL_WORD.fullmatch(word):
            for suffix in suffixes:
                if word.endswith(suffix) and len(word) > len(suffix) + 1:
                    word = word[: -len(suffix)]
                    break
        elif not _EAST.search(word):
            continue
        for i in range(len(word)):
            out[word[i]] = None
            if i + 2 <= len(word):
                out[word[i : i + 2]] = None
    return list(out)
