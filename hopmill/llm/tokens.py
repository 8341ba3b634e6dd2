"""Token counts by byte-pair merging, without identifiers."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words and pieces that a worker keeps with their counts; a store is emptied when it is full, and longer ones than SHORT are not kept.
CACHE = 1_000_000
SHORT = 64
#: Characters that str.split() takes as white space and the tokenizer does not.
_ODD = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Merges:
    """Ranks of adjacent pairs, the pattern that cuts words into pieces, and the special strings of a vocabulary file."""

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        model = file["model"]
        end = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        self.merged: dict[int, int] = {}  # left symbol and right symbol: rank and new symbol, each packed as high and low
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merged.setdefault(vocabulary[a] << 20 | vocabulary[b], rank << 20 | vocabulary[a + b])
        self.special = [t["content"] for t in file["added_tokens"]]
        steps = file["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        named = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.inner = [vocabulary[named[b]] for b in range(256)]
        self.last = [vocabulary[named[b] + end] for b in range(256)]
        self.counts: dict[str, int] = {}
        self.pieces_seen: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of one piece: its bytes' symbols in a linked list, and a heap of adjacent pairs by rank and place."""
        raw = piece.encode()
        n = len(raw)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        find = self.merged.get
        heap = [m >> 20 << 32 | i for i in range(n - 1) if (m := find(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = right[i]
            if j < 0 or (m := find(symbol[i] << 20 | symbol[j])) is None or m >> 20 != top >> 32:
                continue  # one of the two was merged since
            symbol[i] = m & 0xFFFFF
            right[j], j = -1, right[j]
            right[i] = j
            merges += 1
            if j >= 0:
                left[j] = i
                if (m := find(symbol[i] << 20 | symbol[j])) is not None:
                    heapq.heappush(heap, m >> 20 << 32 | i)
            if (h := left[i]) >= 0 and (m := find(symbol[h] << 20 | symbol[i])) is not None:
                heapq.heappush(heap, m >> 20 << 32 | h)
        return n - merges

    def word(self, word: str) -> int:
        """Tokens of a run of characters between white space, already normalised."""
        seen = self.pieces_seen
        if len(self.counts) >= CACHE:
            self.counts.clear()
        if len(seen) >= CACHE:
            seen.clear()
        total = 0
        for p in self.pieces.findall(word):
            if (n := seen.get(p)) is None:
                n = self.piece(p)
                if len(p) <= SHORT:
                    seen[p] = n
            total += n
        if len(word) <= SHORT:
            self.counts[word] = total
        return total

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        words = _SPACE.split(text) if _ODD.search(text) else text.split()
        get, word = self.counts.get, self.word
        return sum(n if (n := get(w)) is not None else word(w) for w in words)

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_loaded: dict[str, Merges] = {}


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (some MB, read once by the driver) for all executors."""
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def count_tokens(text: Column, vocabulary: Broadcast) -> Column:
    """Tokens (long) of each text, null as empty. Initial symbols minus merges; no begin, end or added tokens.

    Texts are normalised (NFC, lower case) and cut into pieces as the vocabulary's file says; a piece's count does not
    depend on what surrounds it, so each worker keeps the counts of the words it has seen, in a bounded store. Texts are
    handled whole and one at a time, whatever their length.
    """

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name, raw = vocabulary.value
        if name not in _loaded:
            _loaded[name] = Merges(raw)
        merges = _loaded[name]
        for batch in batches:
            yield pa.array([merges.count(t.as_py() or "") for t in batch], pa.int64())

    return counted(text)
