"""Phrase collocation mining by relations (SETM).

The occurrences of the phrases of each length are a stored relation (place, phrase), sorted by place. Places number the words of a piece
in a row and leave a gap between pieces, so equal pieces and adjacent positions are equal places apart from the length. Length by length:

1. merge-join the relation with that of the single words at the adjacent place: the occurrences of phrases one word longer;
2. group and count them: counts of a slice of the text first, then of the corpus, dealt by phrase;
3. semi-join the occurrences with the frequent phrases, and store them as the relation of the next length.

A slice holds documents of one language, about SLICE_BYTES of text, so no piece crosses slices. Only different phrases of a slice are
shuffled, packed by shard; a phrase that most of the corpus holds comes once a slice, however often it occurs. Frequent phrases
are named by numbers, a longer phrase by the numbers of its first part and its last word, so counts are exact. Occurrences that are not yet counted
are joined again for the semi-join, which is cheaper than to store them.

Defined cases: a null text is empty and adds nothing; a null language is `und`; repeated rows count as often as they come; empty pieces have
no words; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import slices, stored, text_of

LEAST, LONGEST, TOP, SHARE = 10, 3, 2000, 50
SLICE_BYTES = 4 << 20
PARTS = 64
#: Different phrases of slices in one shard, on average at most.
SHARD_ROWS = 2_000_000
_MAP = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(rb"[^ \n]+|\n")


def tokens(text: bytes) -> list[bytes]:
    """Words, and a newline where a piece ends."""
    return _TOKEN.findall(text.translate(_MAP))


# ---- packed numbers ---------------------------------------------------------------------------------------------

def squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs, byte planes apart, compressed."""
    numbers = np.ascontiguousarray(numbers, np.int64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    planes = numbers.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loose(cell: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell[1:]), np.uint8).reshape(cell[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :cell[0]] = planes.T
    return out.reshape(-1).view(np.int64)


def squeeze_rising(numbers: np.ndarray) -> bytes:
    return squeeze(np.diff(numbers, prepend=0))


def loose_rising(cell: bytes) -> np.ndarray:
    return np.cumsum(loose(cell))


def _batch(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


_TYPES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}


def _ddl(schema: dict) -> str:
    return ", ".join(f"{n} {_TYPES[t]}" for n, t in schema.items())


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of batches, one at a time as Python values: a row is a slice or a cell."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in columns)


# ---- single words -------------------------------------------------------------------------------------------------

_SLICES = {"lang": pa.string(), "slice": pa.int64(), "n": pa.int64(), "words": pa.list_(pa.string()), "times": pa.binary(), "places": pa.binary(), "names": pa.binary()}


def occurrences(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """A row a slice: its different words, the most frequent first, how often each occurs, and the sorted relation (places, word numbers of the slice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "data", SLICE_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for name, data in zip(batch.column("lang").to_pylist(), batch.column("data").to_pylist()):
                got = tokens(data)
                if got:
                    by_lang.setdefault(name, []).extend([*got, b"\n"])
            for name in list(by_lang):
                at, words = pd.factorize(np.array(by_lang.pop(name), object))
                times = np.bincount(at, minlength=len(words))
                end = next(k for k, w in enumerate(words) if w == b"\n")
                times[end] = 0
                order = np.argsort(-times, kind="stable")  # the mark of an end comes last
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                place = np.flatnonzero(at != end)
                if not len(place):
                    continue
                count += 1
                words = [words[k].decode() for k in order[:-1]]
                yield _batch(_SLICES, [(name, (task << 32) + count, len(place), words, squeeze(times[order[:-1]]), squeeze_rising(place), squeeze(rank[at[place]]))])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("data"))
    return stored(rows.mapInArrow(run, _ddl(_SLICES)), "setm-words")


_WORD_CELLS = {"shard": pa.int64(), "lang": pa.string(), "slice": pa.int64(), "words": pa.list_(pa.string()), "times": pa.binary(), "local": pa.binary()}


def _word_cells(words: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, number, names, times in _rows(batches, "lang", "slice", "words", "times"):
            shard, times = np.array([zlib.crc32(w.encode()) % shards for w in names], np.int64), loose(times)
            order = np.argsort(shard, kind="stable")
            got, starts = np.unique(shard[order], return_index=True)
            yield _batch(_WORD_CELLS, [(int(s), lang, number, [names[k] for k in part], squeeze(times[part]), squeeze_rising(part)) for s, part in zip(got, np.split(order, starts[1:]))])

    return words.select("lang", "slice", "words", "times").mapInArrow(run, _ddl(_WORD_CELLS))


#: Rows of slices (slice, local or mask, numbers) and of frequent phrases (phrase, word or first and last, a).
_COUNTED = {"lang": pa.string(), "slice": pa.int64(), "shard": pa.int64(), "local": pa.binary(), "numbers": pa.binary(),
            "phrase": pa.int64(), "word": pa.string(), "first": pa.int64(), "last": pa.int64(), "a": pa.int64()}


def _numbers(total: np.ndarray, least: int, shard: int, shards: int) -> np.ndarray:
    """Numbers of the frequent phrases of a shard, no other shard gives them; -1 for the others."""
    often = total >= least
    return np.where(often, shard + shards * (np.cumsum(often) - 1), -1)


def _counted_words(cells: DataFrame, shards: int, least: int) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        shard, langs, numbers = table["shard"][0].as_py(), table["lang"].to_pylist(), table["slice"].to_pylist()
        times = [loose(c) for c in table["times"].to_pylist()]
        sizes = [len(t) for t in times]
        lang_at, lang_names = pd.factorize(np.array(langs, object))
        word_at, words = pd.factorize(np.array(table["words"].combine_chunks().flatten().to_pylist(), object))
        key_at, keys = pd.factorize(np.repeat(lang_at, sizes).astype(np.int64) * max(len(words), 1) + word_at)
        total = np.bincount(key_at, np.concatenate(times), len(keys)).astype(np.int64)
        number = _numbers(total, least, shard, shards)
        out, at = [], 0
        for lang, slice_, local, size in zip(langs, numbers, table["local"].to_pylist(), sizes):
            mine = number[key_at[at:at + size]]
            at += size
            if (mine >= 0).any():
                out.append((lang, slice_, shard, squeeze_rising(loose_rising(local)[mine >= 0]), squeeze(mine[mine >= 0]), None, None, None, None, None))
        for k in np.flatnonzero(number >= 0):
            out.append((lang_names[keys[k] // len(words)], None, shard, None, None, int(number[k]), words[keys[k] % len(words)], None, None, int(total[k])))
        return pa.Table.from_batches([_batch(_COUNTED, out)])

    return stored(cells.groupBy("shard").applyInArrow(count, _ddl(_COUNTED)), "setm-counts")


# ---- relations ----------------------------------------------------------------------------------------------------

#: The sorted occurrences of the phrases of one length (null for single words) and of the frequent single words.
_RELATION = {"lang": pa.string(), "slice": pa.int64(), "places": pa.binary(), "names": pa.binary(), "ids": pa.binary(),
             "w_places": pa.binary(), "w_names": pa.binary(), "w_ids": pa.binary()}


def _frequent(counted: DataFrame) -> DataFrame:
    return counted.where("slice IS NULL").select("lang", "phrase", "a", "word", "first", "last")


def _back(counted: DataFrame) -> DataFrame:
    """Per slice what was found of it, a part a shard; as many numbers as the slice has different frequent phrases."""
    cells = counted.where("slice IS NOT NULL").groupBy(F.col("slice").alias("s"))
    return cells.agg(F.collect_list(F.struct("shard", "local", "numbers")).alias("found"))


def _word_relation(words: DataFrame, counted: DataFrame) -> DataFrame:
    """The semi-join of the single words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, slice_, size, places, names, found in _rows(batches, "lang", "slice", "size", "places", "names", "found"):
            number = np.full(size, -1, np.int64)
            for f in found:
                number[loose_rising(f["local"])] = loose(f["numbers"])
            named = number[(at := loose(names))] >= 0
            rank = np.cumsum(number >= 0) - 1  # the slice's own numbers of its frequent words
            yield _batch(_RELATION, [(lang, slice_, None, None, None, squeeze_rising(loose_rising(places)[named]), squeeze(rank[at[named]]), squeeze(number[number >= 0]))])

    both = words.select("lang", "slice", F.size("words").alias("size"), "places", "names").join(_back(counted), F.col("slice") == F.col("s"))
    return stored(both.select("lang", "slice", "size", "places", "names", "found").mapInArrow(run, _ddl(_RELATION)), "setm-relation")


def _merge_joined(row: tuple, length: int, shards: int):
    """Occurrences of the phrases of `length` words with the next word: places, numbers of the slice's different longer phrases, and of these first part,
    last word, count and shard, in the order of (shard, first, last)."""
    places, names, ids, w_places, w_names, w_ids = row
    right, single, w_ids = loose_rising(w_places), loose(w_names), loose(w_ids)
    left, phrase, ids = (right, single, w_ids) if places is None else (loose_rising(places), loose(names), loose(ids))
    at = np.searchsorted(right, left + length)  # both sides are sorted by place
    hit = np.flatnonzero(right[np.minimum(at, len(right) - 1)] == left + length)
    pair = phrase[hit] * len(w_ids) + single[at[hit]]
    keys, named, times = np.unique(pair, return_inverse=True, return_counts=True)
    first, last = ids[keys // len(w_ids)], w_ids[keys % len(w_ids)]
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    shard = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(33)) % np.uint64(shards)
    order = np.lexsort((last, first, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return left[hit], rank[named], first[order], last[order], times[order], shard[order].astype(np.int64)


_PARTS = ("places", "names", "ids", "w_places", "w_names", "w_ids")
_CELLS = {"shard": pa.int64(), "lang": pa.string(), "slice": pa.int64(), "first": pa.binary(), "last": pa.binary(), "times": pa.binary()}


def _phrase_cells(relation: DataFrame, length: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, slice_, *row in _rows(batches, "lang", "slice", *_PARTS):
            _, _, first, last, times, shard = _merge_joined(row, length, shards)
            got, starts = np.unique(shard, return_index=True)
            ends = np.append(starts[1:], len(shard))
            if len(got):
                yield _batch(_CELLS, [(int(s), lang, slice_, squeeze_rising(first[lo:hi]), squeeze(last[lo:hi]), squeeze(times[lo:hi])) for s, lo, hi in zip(got, starts, ends)])

    return relation.mapInArrow(run, _ddl(_CELLS))


def _counted_phrases(cells: DataFrame, shards: int, least: int) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        shard, langs, numbers = table["shard"][0].as_py(), table["lang"].to_pylist(), table["slice"].to_pylist()
        first = [loose_rising(c) for c in table["first"].to_pylist()]
        sizes = np.array([len(f) for f in first])
        first = np.concatenate(first)
        last = np.concatenate([loose(c) for c in table["last"].to_pylist()])
        order = np.lexsort((last, first))
        f, l = first[order], last[order]
        new = np.concatenate(([True], (np.diff(f) != 0) | (np.diff(l) != 0)))
        heads = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate([loose(c) for c in table["times"].to_pylist()])[order], heads)
        number = _numbers(total, least, shard, shards)
        mine = np.empty(len(order), np.int64)
        mine[order] = number[np.cumsum(new) - 1]
        out, at = [], 0
        for lang, slice_, size in zip(langs, numbers, sizes):
            here = mine[at:at + size]
            at += size
            often = here >= 0
            if often.any():
                # keys and numbers rise together in a cell
                out.append((lang, slice_, shard, squeeze_rising(np.flatnonzero(often)), squeeze_rising(here[often]), None, None, None, None, None))
        # the numbers of a phrase's words belong to one language
        lang_at = np.repeat(np.arange(len(langs)), sizes)[order[heads]]
        for k in np.flatnonzero(number >= 0):
            out.append((langs[lang_at[k]], None, shard, None, None, int(number[k]), None, int(f[heads[k]]), int(l[heads[k]]), int(total[k])))
        return pa.Table.from_batches([_batch(_COUNTED, out)])

    return stored(cells.groupBy("shard").applyInArrow(count, _ddl(_COUNTED)), "setm-counts")


def _phrase_relation(relation: DataFrame, counted: DataFrame, length: int, shards: int) -> DataFrame:
    """The semi-join: the occurrences of phrases one word longer than `length`, of the frequent ones only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, slice_, found, *row in _rows(batches, "lang", "slice", "found", *_PARTS):
            places, names, _, _, _, shard = _merge_joined(row, length, shards)
            number = np.full(len(shard), -1, np.int64)
            starts = dict(zip(*(x.tolist() for x in np.unique(shard, return_index=True))))
            for f in found:
                number[starts[f["shard"]] + loose_rising(f["local"])] = loose_rising(f["numbers"])
            named = number[names] >= 0
            rank = np.cumsum(number >= 0) - 1
            yield _batch(_RELATION, [(lang, slice_, squeeze_rising(places[named]), squeeze(rank[names[named]]), squeeze(number[number >= 0]), *row[3:])])

    both = relation.join(_back(counted), F.col("slice") == F.col("s")).select("lang", "slice", "found", *_PARTS)
    return stored(both.mapInArrow(run, _ddl(_RELATION)), "setm-relation")


# ---- the operator --------------------------------------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of each length (lang, phrase, a, word, first, last), and (lang, n)."""
    words = occurrences(docs, text, lang)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("w")).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # a slice has no more different phrases than words
    word_shards, shards = (max(cores, -(-size[c] // SHARD_ROWS)) for c in ("w", "n"))
    counted = _counted_words(_word_cells(words, word_shards), word_shards, least)
    found, relation = [_frequent(counted)], _word_relation(words, counted)
    for length in range(1, longest):
        counted = _counted_phrases(_phrase_cells(relation, length, shards), shards, least)
        found.append(_frequent(counted))
        if length + 1 < longest:
            relation = _phrase_relation(relation, counted, length, shards)
    return found, words.groupBy("lang").agg(F.sum("n").alias("n"))


def _candidates(found: list[DataFrame]) -> list[DataFrame]:
    """For each length: phrase, lang, text, a, rest (the phrase without its first word), lefts and rights (occurrences of the first
    words and of the other ones, a cut after one word first)."""
    words = found[0].select(F.col("phrase").alias("w"), F.col("word").alias("next"), F.col("a").alias("next_a"))
    longs = "array<long>"
    tables = [found[0].select("lang", "phrase", F.col("word").alias("text"), "a", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
                              F.lit(None).cast("long").alias("rest"), F.array().cast(longs).alias("lefts"), F.array().cast(longs).alias("rights"))]
    for length, longer in enumerate(found[1:], 2):
        head = tables[-1].select(F.col("phrase").alias("h"), F.col("text").alias("h_text"), F.col("a").alias("h_a"), F.col("rest").alias("h_rest"), F.col("lefts").alias("h_lefts"))
        rows = longer.drop("word").join(head, F.col("first") == F.col("h")).join(words, F.col("last") == F.col("w"))
        if length == 2:
            rows = rows.withColumns({"rest": F.col("last"), "r_a": F.col("next_a"), "r_rights": F.array().cast(longs)})
        else:  # the words after the first are frequent too, as often as the phrase at least
            tail = tables[-1].select(F.col("phrase").alias("rest"), F.col("first").alias("r_first"), F.col("last").alias("r_last"), F.col("a").alias("r_a"), F.col("rights").alias("r_rights"))
            rows = rows.join(tail, (F.col("h_rest") == F.col("r_first")) & (F.col("last") == F.col("r_last")))
        tables.append(stored(rows.select(
            "lang", "phrase", F.concat_ws(" ", "h_text", "next").alias("text"), "a", "first", "last", "rest",
            F.concat("h_lefts", F.array("h_a")).alias("lefts"), F.concat(F.array("r_a"), "r_rights").alias("rights")), "setm-candidates"))
    return tables[1:]


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 a a / (left right)), whole: counts up to 10**13, products in decimals of up to 33 digits."""
    a, left, right = (c.cast("decimal(13,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` candidates of every language.

    The lowest-scoring cut counts; a phrase goes if a longer candidate around it has `share` percent of its occurrences.
    """
    found, sizes = frequent_phrases(docs, least, longest, text, lang)
    tables, kept = _candidates(found), None
    for k, rows in enumerate(tables):
        if k + 1 < len(tables):
            # a candidate two words longer occurs no more often than one between the two
            around = tables[k + 1].select(F.explode(F.array("first", "rest")).alias("p"), F.col("a").alias("around")).groupBy("p").agg(F.max("around").alias("around"))
            rows = rows.join(around, F.col("phrase") == F.col("p"), "left").where((F.coalesce("around", F.lit(0)) * 100 < F.col("a") * share))

        def cut(left, k):
            right = F.get("rights", k)
            return F.struct(score(F.col("a"), left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))
        rows = rows.withColumn("cut", F.array_min(F.transform("lefts", cut))).select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        kept = rows if kept is None else kept.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of each part first, so that a language's last ranking gets PARTS * top rows at most
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    kept = kept.withColumn("part", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("part") <= top).drop("part")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
