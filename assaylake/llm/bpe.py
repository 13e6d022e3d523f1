"""BPE encoding and decoding with a word vocabulary, by a contiguous rank array per word.

A text is cut at the literal special tokens, normalised and split into short words. A word's parts lie in one array of
boundaries with the rank of each adjacent pair beside it: the smallest rank is found by a scan, its right boundary deleted,
and the two neighbouring ranks refreshed, until no pair has a rank. A word of over LONG_WORD letters, where scans would be
quadratic, keeps its ranks in a heap with the same order of merges. Words repeat, so each task keeps the
results of up to CACHE_WORDS words and starts anew beyond. Decoding looks the ids up and joins the tokens with blanks, as the tokenizers library does
for a vocabulary without a decoder.

Defined cases: a null text is empty and gives no ids; the text of a special token gives its id; rows are independent,
so repeated rows, ties and null ids don't matter; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_of

#: Words whose results a task keeps.
CACHE_WORDS = 400_000
#: Words of more letters take a heap instead of the scan, and are not cached.
LONG_WORD = 512
_NONE = 1 << 60

# The pattern that splits normalised text into words, the word end mark, the white space that counts as one blank.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
BLANKS = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes and decodes with one vocabulary file; `words` caches (ids, tokens) of whole words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"]
        self.ranks = {(a, b): r for r, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(WORDS)
        self.blank = regex.compile(BLANKS)
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.cache: dict[str, tuple] = {}

    def parts(self, word: str) -> list[str]:
        """The vocabulary tokens of one word."""
        text = word.encode().decode("latin-1").translate(self.letters)
        get = self.ranks.get
        # part k reaches from one boundary to the next; the end mark belongs to the last letter
        bounds = [*range(len(text)), len(text) + len(WORD_END)]
        text += WORD_END
        if len(bounds) > LONG_WORD:
            return self._long_parts(text, bounds)
        rank = lambda k: get((text[bounds[k]:bounds[k + 1]], text[bounds[k + 1]:bounds[k + 2]]), _NONE)
        ranks = [rank(k) for k in range(len(bounds) - 2)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            k = ranks.index(low)
            del bounds[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank(k)
            if k:
                ranks[k - 1] = rank(k - 1)
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def _long_parts(self, text: str, bounds: list[int]) -> list[str]:
        """The same for a long word: a heap of (rank, place) names the next pair, neighbours are linked, overtaken entries are skipped."""
        get, n = self.ranks.get, len(bounds) - 1
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), bounds[1:]
        ranks = [_NONE] * n

        def rank(k: int) -> int:
            right = after[k]
            return get((text[bounds[k]:ends[k]], text[bounds[right]:ends[right]]), _NONE) if right < n else _NONE

        heap = []
        for k in range(n):
            ranks[k] = rank(k)
            if ranks[k] != _NONE:
                heap.append((ranks[k], k))
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            if ranks[k] != low:
                continue
            gone = after[k]
            ends[k], after[k], ranks[gone] = ends[gone], after[gone], _NONE
            if after[k] < n:
                before[after[k]] = k
            for at in (k, before[k]):
                if at >= 0:
                    ranks[at] = rank(at)
                    if ranks[at] != _NONE:
                        heapq.heappush(heap, (ranks[at], at))
        out, k = [], 0
        while k < n:
            out.append(text[bounds[k]:ends[k]])
            k = after[k]
        return out

    def word(self, word: str) -> tuple:
        """(number of ids, ids joined by blanks, tokens joined by blanks, ids as little-endian 32-bit words)"""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        parts = self.parts(word)
        ids = [self.ids[p] for p in parts]
        out = len(ids), " ".join(map(str, ids)), " ".join(parts), b"".join(i.to_bytes(4, "little") for i in ids)
        if len(word) <= LONG_WORD:  # so the cache is bounded in bytes too
            self.cache[word] = out
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            # each letter is lowered alone, so a final sigma gets no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.blank.sub(" ", text).lower()

    def words(self, text: str) -> list[tuple]:
        """The cached results of all words of a text, in order."""
        if "<|" in text and (pieces := self.cut.split(text))[1:]:
            out = []
            for k, piece in enumerate(pieces):
                if k % 2:
                    i = self.special[piece]
                    out.append((1, str(i), piece, i.to_bytes(4, "little")))
                elif piece:
                    out += self._plain(piece)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple]:
        found = self.split.findall(self.normal(text))
        get = self.cache.get
        return [get(w) or self.word(w) for w in found]

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.words(text) for i in w[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_digests(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", 8 << 20):
            counts, ids, decoded = [], [], []
            for t in batch.column("text").to_pylist():
                words = enc.words(t)
                counts.append(sum(w[0] for w in words))
                ids.append(hashlib.sha256(" ".join([w[1] for w in words]).encode()).hexdigest())
                # the tokens of a word are the decoded ids, looked up once per word
                decoded.append(hashlib.sha256(" ".join([w[2] for w in words]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([enc.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))],
                names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, text, from the column ids; null ids give an empty text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
