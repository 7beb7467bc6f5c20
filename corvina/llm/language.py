"""Problem 5: the language of documents and of their lines, by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three characters, words bounded by blanks) in order
of frequency.  A text's own n-grams are ranked in the same way; the distance to a language is the sum of how far each
stands out of place, with a fixed penalty for one the profile lacks.  The nearest profile names the language and the
lead over the second gives the confidence.

Profiles are trained here, on at most ``TRAINING`` documents (those with the least hash of their id among the documents
whose two labels agree) and the list of common words.  Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.analysis import common_words, listed_words, read_pages, vote
from corvina.llm.canonical import transducer

LANGUAGES = ("en", "fr", "de", "es", "pt", "ko", "ja", "zh")

#: Documents the profiles are trained on at most, n-grams of a profile, n-grams of a text that are ranked.
TRAINING, PROFILE, RANKED = 2_000, 400, 300

#: Characters compared at once: as many as the processor's cache holds well.
BATCH = 60_000

#: Lines of at least so many characters are segments of their own.
LEAST_LINE = 40

#: A line is in another language than its text only if that language leads by this share of the distance.
LEAD = 0.3

_OTHER = re.compile(r"[\W\d_]+")
_ASCII_OTHER = {c: " " for c in range(128) if not chr(c).isalpha()}
_EAST = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_WEST = re.compile(r"[a-zß-ɏ]+")
_URL = re.compile(r"(?:https?://|www\.)\S+")


def plain(text: str) -> str:
    """Letters in lower case, everything else one blank, a blank at either end.

    Where a fifth of the letters or more are Han, kana or Hangul, Latin letters are foreign names and left out.
    """
    low = _URL.sub(" ", text).lower() if "://" in text or "www." in text else text.lower()
    if low.isascii():
        return " " + " ".join(low.translate(_ASCII_OTHER).split()) + " "
    if len(_EAST.findall(low)) * 5 >= len(low):
        low = _WEST.sub(" ", low)
    return " " + _OTHER.sub(" ", low).strip() + " "


def grams(text: str) -> Counter:
    """Counts of the one- to three-character n-grams of a plain text, without blanks on their own."""
    out = Counter(text)
    out.update(map("".join, zip(text, text[1:])))
    out.update(map("".join, zip(text, text[1:], text[2:])))
    out.pop(" ", None)
    return out


class Profiles:
    """Profiles of all languages, laid out as tables for looking up whole batches."""

    def __init__(self, ranked: dict[str, list[str]]) -> None:
        self.languages = [x for x in LANGUAGES if ranked.get(x)]
        union = sorted({g for x in self.languages for g in ranked[x]})
        self.size = len(union)
        place = {g: i for i, g in enumerate(union)}
        self.ranks = np.full((len(self.languages), self.size), PROFILE, dtype=np.int32)
        for k, x in enumerate(self.languages):
            for r, g in enumerate(ranked[x]):
                self.ranks[k, place[g]] = r
        self.by_gram = np.ascontiguousarray(self.ranks.T.astype(np.int16))
        self.least = self.ranks.min(axis=0).astype(np.int64) if self.size else np.zeros(0, dtype=np.int64)
        chars = sorted({c for g in union for c in g})
        self.char = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(chars):
            self.char[ord(c)] = i + 1
        self.width = width = len(chars) + 1
        code = {c: i + 1 for i, c in enumerate(chars)}
        self.one = np.full(width, -1, dtype=np.int16)
        self.two = np.full(width * width, -1, dtype=np.int16)  # fewer n-grams than 2 ** 15: all profiles together
        heads = sorted({g[:2] for g in union if len(g) == 3})
        self.head = np.zeros(width * width, dtype=np.int16)
        for i, h in enumerate(heads):
            self.head[code[h[0]] * width + code[h[1]]] = i + 1
        self.three = np.full((len(heads) + 1) * width, -1, dtype=np.int16)
        for g, i in place.items():
            if len(g) == 1:
                self.one[code[g]] = i
            elif len(g) == 2:
                self.two[code[g[0]] * width + code[g[1]]] = i
            else:
                self.three[int(self.head[code[g[0]] * width + code[g[1]]]) * width + code[g[2]]] = i

    def distances(self, texts: Sequence[str]) -> np.ndarray:
        """Mean out-of-place distance (0 to 1) of each plain text to each language; 1 for a text none of whose n-grams is known.

        N-grams that no profile has would add the same to every language's sum and are left out of the mean.
        """
        lengths = np.array([len(t) for t in texts])
        chars = self.char[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        # Keys of (text, n-gram) fit 32 bits: a batch has fewer texts than BATCH / 4, and all profiles fewer n-grams than 2 ** 12.
        narrow = np.int32 if len(texts) * (self.size + 1) < 2**31 else np.int64
        of = np.repeat(np.arange(len(texts), dtype=narrow) * self.size, lengths)
        pair = chars[:-1] * self.width + chars[1:]
        same = of[:-1] == of[1:]
        two = np.where(same, self.two[pair], -1)
        head = np.where(same, self.head[pair], 0)
        three = np.where(same[1:], self.three[head[:-1].astype(np.int32) * self.width + chars[2:]], -1) if len(chars) > 2 else np.zeros(0, dtype=np.int16)
        one = self.one[chars]
        found = np.concatenate([one, two, three])
        keys = np.concatenate([of, of[:-1], of[: len(three)]])
        keep = found >= 0
        keys, n = np.unique(keys[keep] + found[keep], return_counts=True)
        owner, found = keys.astype(np.int64) // self.size, keys.astype(np.int64) % self.size
        # By text, then frequency, ties in the order of the n-grams' least rank over the languages, so that they favour
        # none; all packed into one number, which sorts fastest.
        packed = np.sort(((owner << 20 | (1 << 20) - 1 - np.minimum(n, (1 << 20) - 1)) * (PROFILE + 1) + self.least[found]) * self.size + found)
        found = packed % self.size
        owner = packed // (self.size * (PROFILE + 1)) >> 20
        first = np.searchsorted(owner, np.arange(len(texts)))
        rank = np.arange(len(owner)) - first[owner]
        kept = rank < RANKED
        owner, found, rank = owner[kept], found[kept], rank[kept]
        total = np.bincount(owner, minlength=len(texts))
        out = np.ones((len(texts), len(self.languages)))
        some = total > 0
        if len(owner):
            # One row per n-gram, one column per language; a text's rows stand together.
            ranks = self.by_gram[found]
            away = np.abs(ranks - rank[:, None].astype(np.int16))
            away[ranks == PROFILE] = PROFILE
            starts = np.concatenate([[0], np.cumsum(total[some])[:-1]])
            out[some] = np.add.reduceat(np.minimum(away, PROFILE), starts, axis=0, dtype=np.int64) / (total[some] * PROFILE)[:, None]
        return out


def train(documents: DataFrame, words: DataFrame, *, training: int = TRAINING) -> Profiles:
    """Profiles from at most ``training`` documents and the common words (a fixed small list)."""
    declared = F.lower(F.substring(F.trim("language"), 1, 2))
    agreed = documents.where(F.col("text").isNotNull() & declared.isin(*LANGUAGES) & (declared == F.lower(F.substring("lang", 1, 2))))
    # Rows are thinned out by their hash before they are ordered, so that what reaches the driver is about the sample.
    found = agreed.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))
    thin = agreed.select(declared.alias("label"), "text", place.alias("h")).where(F.col("h") < min(1.0, 1.2 * training / max(found, 1)) * 1_000_000_000)
    sample = thin.orderBy("h").limit(training).collect()
    counts = {x: Counter() for x in LANGUAGES}
    apply = transducer().apply
    for row in sample:
        counts[row.label].update(grams(plain(apply(row.text))))
    for row in listed_words(words):
        if row.word and row.lang in counts:
            counts[row.lang].update(grams(plain(row.word)))
    return Profiles({x: [g for g, _ in sorted(c.items(), key=lambda y: (-y[1], y[0]))[:PROFILE]] for x, c in counts.items()})


def segments(text: str, forms: Sequence[str] | None = None) -> list[tuple[int, str]]:
    """(line number, plain text) of every line long enough, and (0, plain text) of all shorter ones together.

    Lines with too few letters to tell (tables, addresses) go with the short ones.  ``forms`` holds the lines in
    consistent form where they are known already.
    """
    out, short, apply = [], [], transducer().apply
    for number, raw in enumerate(text.split("\n"), 1):
        line = apply(raw) if forms is None else forms[number - 1]
        form = plain(line)
        if len(form) < 4:
            continue
        if len(raw) >= LEAST_LINE and len(form) >= 14 and len(form) - form.count(" ") >= 0.5 * (len(line) - line.count(" ")):
            out.append((number, form))
        else:
            short.append(form)
    if short:
        out.append((0, " ".join(short)))
    return out


def judge(profiles: Profiles, pages: Iterable[tuple]) -> Iterable[tuple]:
    """For (key, text) pages: (key, language, confidence, [(line, language, confidence), ...]).

    A document's language is that of the greater part of its text by characters.  Its confidence is the share of that
    part, times how far its lines are nearer to that language than to the second (0 for equally near, towards 1).  A
    line's confidence is its lead over the document's language.  Texts without letters give a null language.
    """
    held: list[tuple] = []
    texts: list[str] = []

    def settle() -> Iterable[tuple]:
        far = profiles.distances(texts) if texts else np.zeros((0, len(profiles.languages)))
        near = far.argmin(axis=1).tolist() if len(texts) else []
        leads = [0.0] * len(texts)
        if len(texts) and len(profiles.languages) > 1:
            two = np.partition(far, 1, axis=1)[:, :2]
            leads = (1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)).tolist()
        at = 0
        for key, numbers, sizes in held:
            first, at = at, at + len(numbers)
            if not numbers:
                yield key, None, 0.0, []
                continue
            weight, lead_of = [0] * len(profiles.languages), [0.0] * len(profiles.languages)
            for best, lead, size in zip(near[first:at], leads[first:at], sizes):
                weight[best] += size
                lead_of[best] += size * lead
            own = weight.index(max(weight))
            lines = []
            for k, number in enumerate(numbers, first):
                if number and near[k] != own:
                    lead = float((far[k, own] - far[k, near[k]]) / max(far[k, own], 1e-9))
                    if lead >= LEAD:
                        lines.append((number, profiles.languages[near[k]], lead))
            yield key, profiles.languages[own], lead_of[own] / sum(weight), lines
        held.clear()
        texts.clear()

    size = 0
    for key, text, *forms in pages:
        parts = segments(text, *forms)
        held.append((key, [n for n, _ in parts], [len(t) for _, t in parts]))
        texts.extend(t for _, t in parts)
        size += sum(len(t) for _, t in parts)
        if size > BATCH:
            yield from settle()
            size = 0
    yield from settle()


_SEGMENTS = "array<struct<line_no: bigint, lang: string, confidence: double>>"
_ROWS = f"url string, residue boolean, body_chars long, votes string, lang string, confidence double, segments {_SEGMENTS}"


def languages(pages: DataFrame, documents: DataFrame, words: DataFrame, *, training: int = TRAINING) -> DataFrame:
    """(url, residue, body_chars, votes, lang, confidence, segments) of every page of (url, title, text) with a text.

    ``segments`` lists the lines in another language than the greater part of the text.
    """
    sent = pages.sparkSession.sparkContext.broadcast((train(documents, words, training=training), common_words(words)))

    def each(read) -> Iterable[pa.RecordBatch]:
        profiles, common = sent.value
        schema = pa.schema([("url", pa.string()), ("residue", pa.bool_()), ("body_chars", pa.int64()), ("votes", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("segments", pa.list_(pa.struct([("line_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())])))])

        def keyed():
            for url, page, text in read:
                size = sum(len(u.text) for u in page.units)
                yield (url, page.residue, size, vote(page, common)), text, page.forms

        rows: list[tuple] = []
        for key, lang, confidence, lines in judge(profiles, keyed()):
            rows.append((*key, lang, confidence, [{"line_no": n, "lang": x, "confidence": c} for n, x, c in lines]))
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return read_pages(pages, documents, words, each, _ROWS)
