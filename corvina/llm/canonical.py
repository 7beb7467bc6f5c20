"""Problem 1: text that looks the same but is stored with different characters.

A longest-match transducer over grapheme clusters (a base with its marks, conjoining letters of a syllable, ...)
rewrites a text in a single pass.  Its mapping is computed once, by rule from the Unicode database and the fixed lists
below: every code point of every plane that isn't in the consistent form already, every base with one or two marks that
compose, also behind look-alike bases.  It is checked for conflicts and compiled to one table and one scanner; ``apply``
looks the scanned clusters up, longest first.  Only clusters that no finite table can hold (stacks of more marks) are
put together from the table's entries by the rule it was made from.

Kept apart: letter case, accents, digits, punctuation, words and line breaks.  Brought together: letter widths,
composed and decomposed accents and syllables, joined letters, contextual forms, invisible characters, kinds of space,
and letters of another script drawn alike.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that are drawn like a Latin letter, by script and case.
LOOK_ALIKE = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ѵ": "v", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ѵ": "V", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    # Greek, small
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ք": "p", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Latin letters of phonetic alphabets
    "ɑ": "a", "ɡ": "g", "ɩ": "i",
}

# Characters that show nothing (soft hyphen, zero-width characters, direction marks, joiners, fillers, variation selectors, tags).
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000)]
_HIDDEN = frozenset(INVISIBLE)

# Code points that may be mapped, or be marks: the basic plane and the blocks beyond it that hold any (a test goes through all planes).
_BLOCKS = ((0x80, 0xD800), (0xE000, 0x10000), (0x10100, 0x10400), (0x10A00, 0x10F90), (0x11000, 0x12000), (0x13430, 0x13460), (0x16100, 0x16140), (0x16AF0, 0x16B40), (0x16D60, 0x16D70), (0x16F40, 0x16FF8), (0x1BC90, 0x1BCB0), (0x1CF00, 0x1CF50), (0x1D150, 0x1D250), (0x1DA00, 0x1DAB0), (0x1E000, 0x1E960), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))

# Compatibility mappings that change nothing a reader sees: width, contextual forms.
_SAME_LOOK = frozenset(("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>"))

# Joined letters (Latin and Armenian ligatures, digraphs) and radicals that stand for their ideographs.
_JOINED = (*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x0132, 0x0133, 0x0149, *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), *range(0x2F00, 0x2FD6), 0x2E9F, 0x2EF3)
_JOINED_SET = frozenset(_JOINED)


def _one(char: str) -> str:
    """The form of a single code point, before composition."""
    code = ord(char)
    if code in _HIDDEN:
        return ""
    if unicodedata.category(char) == "Zs":
        return " "
    kind, *codes = unicodedata.decomposition(char).split(" ")
    if kind in _SAME_LOOK and (kind in ("<wide>", "<narrow>") or unicodedata.category(char)[0] == "L"):
        # One step only: half-width letters of syllables stay letters on their own.
        apart = "".join(chr(int(c, 16)) for c in codes)
        if " " not in apart and not any(ord(c) in _HIDDEN for c in apart):
            char = apart
        elif any(ord(c) in _HIDDEN for c in apart):
            return ""
    elif code in _JOINED_SET:
        char = unicodedata.normalize("NFKC", char)
    return "".join(LOOK_ALIKE.get(c, c) for c in char)


def _compose(text: str) -> str:
    """The rule the table is made from: every code point is mapped, decomposed, mapped and composed again; invisible ones vanish."""
    apart = unicodedata.normalize("NFD", "".join(map(_one, text)))
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(c, c) for c in apart if ord(c) not in _HIDDEN))


def _class(chars: Iterable[str]) -> str:
    """A character class of ``chars`` in ranges."""
    out, codes = [], sorted(map(ord, chars))
    first = last = codes[0]
    for code in [*codes[1:], 0x110000]:
        if code != last + 1:
            out.append(re.escape(chr(first)) + ("-" + re.escape(chr(last)) if last > first else ""))
            first = code
        last = code
    return "[" + "".join(out) + "]"


class Transducer:
    """The compiled mapping: ``apply`` rewrites a text in one left-to-right, longest-match pass."""

    def __init__(self) -> None:
        table: dict[str, str] = {}
        marks: list[str] = []
        composed: list[str] = []
        for first, last in _BLOCKS:
            for code in range(first, last):
                char = chr(code)
                form = _compose(char)
                if form != char:
                    table[char] = form
                if unicodedata.category(char)[0] == "M" and code not in _HIDDEN:
                    marks.append(char)
                elif form == char and unicodedata.decomposition(char)[:1] not in ("", "<") and not 0xAC00 <= code < 0xD7A4:
                    composed.append(char)
        single = dict(table)
        # What composes: a base and one or two marks in any order, the base also half composed or drawn alike.
        drawn: dict[str, list[str]] = {}
        for source, form in single.items():
            if len(form) == 1:
                drawn.setdefault(form, []).append(source)
        for char in composed:
            base, *tail = unicodedata.normalize("NFD", char)
            stacks = {tuple(tail), tuple(reversed(tail))} if len(tail) <= 2 else {tuple(tail)}
            heads = [(base, stack) for stack in stacks]
            if len(tail) == 2:
                heads += [(half, (mark,)) for mark, other in ((tail[0], tail[1]), (tail[1], tail[0])) if len(half := unicodedata.normalize("NFC", base + other)) == 1]
            for head, stack in heads:
                for start in (head, *drawn.get(head, ())):
                    for end in itertools.product(*[(m, *drawn.get(m, ())) for m in stack]):
                        key = start + "".join(end)
                        form = _compose(key)
                        if form != key:
                            table[key] = form
        check(table)
        self.table = table
        self.seen: dict[str, str] = {}
        self.longest = max(map(len, table))
        hidden = "".join(map(chr, sorted(_HIDDEN)))
        joins = {*marks, *hidden, *(c for c in single if single[c] and unicodedata.category(single[c][0])[0] == "M"), *map(chr, range(0x1160, 0x1200))}
        self.joining = frozenset(joins)
        # A run of characters that take part; everything else is passed over.  Beyond the basic plane, where the standard
        # library's classes are slow, every character is looked at.
        near = [c for c in {*single, *joins, *map(chr, range(0x1100, 0x1160))} if c < "\U00010000"]
        self.scanner = re.compile(_class(near)[:-1] + "\U00010000-\U0010ffff]+")
        follow = _class(joins)
        self.clusters = re.compile(f"[\u1100-\u115f]+{follow}*|(?s:.){follow}*")

    def apply(self, text: str) -> str:
        """``text`` rewritten; a run of characters that take part is taken with the base it joins on to."""
        if text.isascii():
            return text
        out, last, get, cluster = [], 0, self.table.get, self._cluster
        for found in self.scanner.finditer(text):
            start, end = found.span()
            if start > last and text[start] in self.joining and text[start - 1] != "\n":
                start -= 1
            out.append(text[last:start])
            run = text[start:end]
            form = get(run)
            if form is None:
                form = self.seen.get(run)
                if form is None:
                    form = "".join([get(c) if c in self.table else cluster(c) for c in self.clusters.findall(run)])
                    if len(run) <= 12:
                        if len(self.seen) >= 50_000:
                            self.seen.clear()
                        self.seen[run] = form
            out.append(form)
            last = end
        if not last:
            return text
        out.append(text[last:])
        return "".join(out)

    def _cluster(self, cluster: str) -> str:
        """The form of a cluster that isn't in the table as a whole: without invisible characters, by its longest known start."""
        shown = "".join([c for c in cluster if ord(c) not in _HIDDEN])
        if shown in self.table:
            return self.table[shown]
        if len(shown) <= 1:
            return shown
        for size in range(min(self.longest, len(shown) - 1), 0, -1):
            form = self.table.get(shown[:size])
            if form is not None:
                return _compose(form + shown[size:])
        return _compose(shown)


def check(table: dict[str, str]) -> None:
    """Raise if the mapping has conflicts.

    Every output must be left alone by the mapping, character by character, so that no two rules fight over a cluster;
    and nothing a reader can tell apart may become the same: a letter's case stays, digits and letters don't turn into
    each other or into anything else, a visible mark is never lost, line breaks are no rule's business.
    """
    for source, form in table.items():
        again = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in form))
        if again != form:
            raise ValueError(f"{_named(source)} maps to {form!r}, which maps on to {again!r}")
        if any(c in source or c in form for c in "\n\r\u2028\u2029\x85"):
            raise ValueError(f"{_named(source)} maps a line break")
        shown = [c for c in source if ord(c) not in _HIDDEN]
        if not shown:
            continue
        if not form:
            if any(unicodedata.normalize("NFKC", c) not in ("", "\u1160") for c in shown):
                raise ValueError(f"{_named(source)} is visible and vanishes")
            continue
        kind = unicodedata.category(shown[0])
        new = unicodedata.category(form[0])
        if kind[0] != new[0] and not (kind[0] in "LM" and new[0] in "LM") and kind not in ("So", "Sk", "Lm", "Nl") and new not in ("Sk", "Sm", "Lm"):
            raise ValueError(f"{_named(source)} ({kind}) becomes {form!r} ({new})")
        if {kind, new} == {"Lu", "Ll"}:
            raise ValueError(f"{_named(source)} changes its case to {form!r}")
        visible = lambda text: sum(unicodedata.combining(c) > 0 for c in unicodedata.normalize("NFD", text))
        if visible("".join(map(_one, shown))) != visible(form):
            raise ValueError(f"{_named(source)} loses a mark in {form!r}")


def _named(text: str) -> str:
    return " ".join(f"U+{ord(c):04X}" for c in text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """One per process."""
    return Transducer()


def canonical(text: str | None) -> str | None:
    """``text`` in the consistent form; null stays null, applying it twice changes nothing more."""
    return None if text is None else transducer().apply(text)


def canonical_column(col: Column) -> Column:
    """The consistent form of a string column (an Arrow-batched UDF; texts of ASCII only pass straight through)."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        apply = transducer().apply
        return pd.Series([None if v is None else apply(v) for v in values], dtype=object)

    return form(col)


_KEYS = T.StructType([T.StructField("look", T.BinaryType()), T.StructField("stored", T.BinaryType())])


def _look_keys(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    apply, md5 = transducer().apply, hashlib.md5
    for batch in batches:
        look, stored = [], []
        for value in batch.column(batch.num_columns - 1).to_pylist():
            form = None if value is None else apply(value)
            if form is None or not form.strip():
                look.append(None)
                stored.append(None)
            else:
                raw = value.encode("utf-8", "surrogatepass")
                stored.append(md5(raw).digest())
                look.append(stored[-1] if form is value else md5(form.encode("utf-8", "surrogatepass")).digest())
        columns = [*batch.columns[:-1], pa.array(look, pa.binary()), pa.array(stored, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "look", "stored"])


def look_keys(df: DataFrame, id_column: str, value: str) -> DataFrame:
    """(``id_column``, look, stored): 128-bit digests of the consistent form and of the stored value.

    Null and blank values give no row.
    """
    rows = df.select(F.col(id_column), F.col(value))
    schema = T.StructType([rows.schema[0], *_KEYS.fields])
    return rows.mapInArrow(_look_keys, schema).where(F.col("look").isNotNull())


#: Rows of one look that meet in one task; more are split.
GROUP_ROWS = 2_048


def look_classes(keyed: DataFrame, id_column: str) -> DataFrame:
    """(id, look, spellings, members): one row per id with the class it looks like, in how many ways that is stored and by how many rows.

    The class is all that is needed to compare or merge; nothing is paired, so a look of any size costs its rows only.
    """
    rows = keyed.select(F.col(id_column).alias("id"), "look", "stored").distinct()
    spellings = rows.groupBy("look", "stored").agg(F.count("*").alias("n")).groupBy("look").agg(F.count("*").alias("spellings"), F.sum("n").alias("members"))
    return rows.select("id", "look").join(spellings, "look").select("id", "look", "spellings", "members")


def look_alike_pairs(keyed: DataFrame, id_column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows with equal ``look`` and different ``stored``.

    Only looks that are stored in two or more ways take part, which is settled by pre-aggregation before anything is
    joined; rows with one and the same stored value never meet each other.  A look with many rows is split: one side of
    its pairs is spread over parts of about ``GROUP_ROWS`` rows, to each of which the other side is sent.  Repeated ids
    give each pair once.
    """
    rows = keyed.select(F.col(id_column).alias("id"), "look", "stored").distinct()
    mixed = rows.groupBy("look").agg(F.min("stored").alias("s0"), F.max("stored").alias("s1"), F.count("*").alias("n")).where("s0 <> s1").select("look", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    rows = rows.join(mixed, "look")
    a = rows.select("look", F.col("stored").alias("stored_a"), F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = rows.select("look", F.col("stored").alias("stored_b"), F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, ["look", "part"]).where("stored_a <> stored_b AND id_a < id_b")
    return pairs.select("id_a", "id_b").distinct()
