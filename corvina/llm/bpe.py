"""Problem 8: encoding texts with a public byte-level BPE vocabulary.

The merge loop keeps the symbols of a piece in a doubly linked list and the possible merges in a priority queue of
(rank, position); an entry whose symbols have changed since it was pushed is stale and skipped.  Decoding concatenates
vocabulary strings.

Pieces (words with their leading space, runs of digits, ...) recur, so each worker keeps a bounded table of encoded
pieces.  A long run of letters is first cut where no vocabulary entry can reach across two neighbouring characters;
no merge could have crossed there, so the ids are the same.

Null and empty texts have the defined encoding "no ids": an empty list.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.session import ship

#: Where the vocabulary files are; a parameter of every query that needs one.
TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the pattern that splits a text into pieces, part of the published vocabulary; the white space is
# Unicode's, to which Python's \s adds the four separators, which count among the other symbols here.
PIECES = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+|[\s--[\x1c-\x1f]]+(?![^\s--[\x1c-\x1f]])|[\s--[\x1c-\x1f]]+"

# The same with the standard library's faster classes, for texts without the characters in which they may differ:
# numbers that are no decimal digits, the four separators, and everything beyond the basic plane.
PLAIN_PIECES = r" ?[^\W\d_]++| ?\d++|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s++"

#: Pieces kept by a worker, and the longest piece (in characters) that is kept or encoded uncut.
CACHE_PIECES = 300_000
LONG_PIECE = 24


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: bytes) -> None:
        self.words: list[bytes] = []
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line:
                word, rank = line.split()
                self.ranks[base64.b64decode(word)] = int(rank)
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}
        self.pieces, self.plain_pieces = regex.compile(PIECES), re.compile(PLAIN_PIECES)
        odd = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Nl", "No")]
        self.odd = re.compile("[\x1c-\x1f" + "".join(map(re.escape, odd)) + "\U00010000-\U0010ffff]")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.crossing: dict[str, bool] = {}
        self.reach = {(word[max(0, k - 3) : k], word[k : k + 3]) for word in self.ranks for k in range(1, len(word)) if word[k] >= 0x80 and word[k - 1] >= 0x80}

    def _merge(self, left: int, right: int) -> int:
        """Rank of the merge of two symbols, -1 if there is none."""
        key = (left, right)
        rank = self.merges.get(key)
        if rank is None:
            if len(self.merges) > 1_000_000:
                self.merges.clear()
            rank = self.merges[key] = self.ranks.get(self.words[left] + self.words[right], -1)
        return rank

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ids = self.byte_ids
        symbols = [ids[b] for b in data]
        size = len(symbols)
        if size < 2:
            return symbols
        before = list(range(-1, size - 1))
        after = [*range(1, size), -1]
        merge = self._merge
        queue = []
        for i in range(size - 1):
            rank = merge(symbols[i], symbols[i + 1])
            if rank >= 0:
                queue.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i, left, right = pop(queue)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = rank, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                new = merge(rank, symbols[k])
                if new >= 0:
                    push(queue, (new, i, rank, symbols[k]))
            h = before[i]
            if h >= 0:
                new = merge(symbols[h], rank)
                if new >= 0:
                    push(queue, (new, h, symbols[h], rank))
        return [s for s in symbols if s >= 0]

    def crosses(self, pair: str) -> bool:
        """Whether any vocabulary entry could hold bytes of both characters of ``pair``; True where it isn't known."""
        known = self.crossing.get(pair)
        if known is None:
            a, b = pair[0].encode("utf-8", "surrogatepass"), pair[1].encode("utf-8", "surrogatepass")
            if len(a) == 3 and len(b) == 3:
                reach = self.reach
                known = any((a[i:], b[:j]) in reach for i in (2, 1, 0) for j in (1, 2, 3))
            else:
                known = True
            if len(self.crossing) > 1_000_000:
                self.crossing.clear()
            self.crossing[pair] = known
        return known

    def _uncached(self, piece: str) -> tuple[int, ...]:
        if len(piece) > 4 and not piece.isascii():
            crosses = self.crosses
            start, out = 0, []
            for i in range(1, len(piece)):
                if not crosses(piece[i - 1 : i + 1]):
                    out += self._kept(piece[start:i])
                    start = i
            if start:
                out += self._kept(piece[start:])
                return tuple(out)
        return tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))

    def _kept(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self._uncached(piece)
            if len(piece) <= LONG_PIECE:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        get, kept = self.cache.get, self._kept
        pieces = (self.pieces if self.odd.search(text) else self.plain_pieces).findall(text)
        return list(chain.from_iterable([get(piece) or kept(piece) for piece in pieces]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a list of ids."""
        return b"".join([self.words[i] for i in ids]).decode("utf-8", "surrogatepass")


_ENCODERS: dict[int, ByteBPE] = {}


def encoder(rank_file: bytes) -> ByteBPE:
    """The encoder of a rank file, made once per process."""
    key = hash(rank_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBPE(rank_file)
    return _ENCODERS[key]


def vocabulary(df: DataFrame, tokenizer: str, tokenizer_dir: str) -> Broadcast:
    """The rank file of ``tokenizer``, read on the driver and broadcast (its size is that of the published file, under 1 MB)."""
    return df.sparkSession.sparkContext.broadcast(Path(tokenizer_dir, f"{tokenizer}.tiktoken").read_bytes())


def token_ids(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(``id_column``, ids ARRAY<INT>) of every row, without special tokens; a map over the rows, with no shuffle."""
    ship(documents.sparkSession)
    held = vocabulary(documents, tokenizer, tokenizer_dir)
    rows = documents.select(F.col(id_column), F.col(text))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        bpe = encoder(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                flat, ends = [], [0]
                for value in part.column(1).to_pylist():
                    flat += bpe.encode(value)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_column, "ids"])

    return rows.mapInArrow(encode, T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counts(documents: DataFrame, *, id_column: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(``id_column``, tokens BIGINT): the length of each text in tokens, 0 for null and empty ones."""
    ship(documents.sparkSession)
    held = vocabulary(documents, tokenizer, tokenizer_dir)
    rows = documents.select(F.col(id_column), F.col(text))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        bpe = encoder(held.value)
        for batch in batches:
            sizes = [len(bpe.encode(value)) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [id_column, "tokens"])

    return rows.mapInArrow(count, T.StructType([rows.schema[0], T.StructField("tokens", T.LongType())]))
