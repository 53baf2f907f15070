"""Benchmark decontamination by searching suffix arrays of the training text.

Documents are cut into shards (blocks of whole documents).  Each task builds a
suffix array over the words of a shard and looks up every suffix of every
benchmark item in it by binary search, one word at a time, for all suffixes at
once.  This gives the range of training suffixes that start with a window, and
the longest verbatim match with its place.  A document lies in one shard, so
nothing is shuffled: the work is one pass over the text.

Words are numbered by their place in the benchmark's vocabulary.  A word
outside it ends every match, so suffixes with too few known words in a row to
hold the shortest window stay out of the array; no match is lost by that.

The benchmark comes in blocks of at most ``block_words`` words.  They pass
through the driver one at a time and each becomes its own broadcast of known
size, so any number of items can be searched.

Defined results: null or wordless text has no words and no hits; items without
words are never found; repeated items count once per ``item_id``; a null
``item_id`` marks words but stands in no list; repeated documents are judged
row by row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.llm.words import ALNUM, Block, Spans, blocks, int64, per_row

SHARD_BYTES = 4 << 20
BLOCK_WORDS = 500_000
DIGEST_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
MATCH_SCHEMA = "doc_id long, word long, item_id string, item_word long, length long"


@dataclass
class Items:
    """A block of benchmark items: vocabulary, word numbers, and for each word its window length (0: no window starts there)."""

    vocabulary: np.ndarray
    words: np.ndarray
    item: np.ndarray
    rest: np.ndarray
    window: np.ndarray
    ids: list


def item_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Items]:
    """Read the items in blocks of bounded size."""
    texts, ids, n = [], [], 0
    rows = items.select(F.col("item_id").cast("string"), F.col("text")).filter("text is not null")
    for row in rows.toLocalIterator():
        texts.append(row[1])
        ids.append(row[0])
        n += len(row[1]) // 2 + 1
        if n >= block_words:
            yield from _packed(texts, ids, window)
            texts, ids, n = [], [], 0
    yield from _packed(texts, ids, window)


def _packed(texts: list, ids: list, window: int) -> Iterator[Items]:
    for block in blocks(pa.array(texts, pa.string()), 1 << 40):
        words = block.spans(ALNUM, lower=True)
        if not len(words):
            return
        vocabulary, numbers = np.unique(words.hash, return_inverse=True)
        size = per_row(words.row, block.n)
        place = np.arange(len(words)) - (np.cumsum(size) - size)[words.row]
        rest = size[words.row] - place
        length = np.minimum(size, window)[words.row]
        yield Items(vocabulary, numbers + 1, words.row, rest, np.where(rest >= length, length, 0), ids)


@dataclass
class Found:
    """Windows found: place in the shard, test suffix, length, and the longest match from there."""

    at: np.ndarray
    suffix: np.ndarray
    length: np.ndarray


class Shard:
    """Suffix array over the words of a block of documents."""

    def __init__(self, words: Spans, items: Items):
        n = len(words)
        spot = np.minimum(np.searchsorted(items.vocabulary, words.hash), len(items.vocabulary) - 1)
        known = items.vocabulary[spot] == words.hash
        deepest = int(items.rest.max())
        # 0 stands for any word that no item has, and for the end of a document.
        self.numbers = np.zeros(n + deepest + 1, np.int64)
        self.numbers[:n] = np.where(known, spot + 1, 0)
        last = np.ones(n, bool)
        last[:-1] = words.row[1:] != words.row[:-1]
        stop = np.flatnonzero(~known | last)
        ahead = np.append(stop, n)[np.searchsorted(stop, np.arange(n))]
        self.run = np.where(known, np.minimum(ahead, n - 1) - np.arange(n) + known[np.minimum(ahead, n - 1)], 0)
        shortest = int(items.window[items.window > 0].min())
        at = np.flatnonzero(self.run >= shortest)
        self.deepest = deepest
        self.array = at[self._order(at, len(items.vocabulary) + 1)]

    def word(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The word ``depth`` places on, 0 beyond the known words of the document."""
        return np.where(depth < self.run[at], self.numbers[at + depth], 0)

    def _order(self, at: np.ndarray, base: int) -> np.ndarray:
        per_key = max(1, 62 // max(1, base.bit_length()))
        keys = []
        for first in range(0, self.deepest, per_key):
            key = np.zeros(len(at), np.int64)
            for depth in range(first, first + per_key):
                key = key * base + (self.word(at, depth) if depth < self.deepest else 0)
            keys.append(key)
        return np.lexsort(keys[::-1])

    def bounds(self, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray, right: bool) -> np.ndarray:
        """Binary search in ``[lo, hi)`` for the first suffix whose word at ``depth`` is not below ``wanted``."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            there = self.word(self.array[mid], depth)
            below = there <= wanted[open_] if right else there < wanted[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]

    def search(self, items: Items) -> tuple[Found, Found]:
        """All windows found, and for each test suffix its longest match."""
        suffix = np.flatnonzero(items.window > 0)
        lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.array), np.int64)
        best_at, best = np.zeros(len(items.words), np.int64), np.zeros(len(items.words), np.int64)
        windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while len(suffix):
            wanted = items.words[suffix + depth]
            lo, hi = self.bounds(lo, hi, depth, wanted, False), self.bounds(lo, hi, depth, wanted, True)
            alive = lo < hi
            suffix, lo, hi = suffix[alive], lo[alive], hi[alive]
            depth += 1
            best[suffix], best_at[suffix] = depth, self.array[lo]
            full = items.window[suffix] == depth
            if full.any():
                count = (hi - lo)[full]
                rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                windows.append((self.array[np.repeat(lo[full], count) + rank], np.repeat(suffix[full], count), np.full(len(rank), depth)))
            more = items.rest[suffix] > depth
            suffix, lo, hi = suffix[more], lo[more], hi[more]
        at, which, length = (np.concatenate(x) for x in zip(*windows)) if windows else (np.zeros(0, np.int64),) * 3
        long_enough = np.flatnonzero((items.window > 0) & (best >= items.window))
        return Found(at, which, length), Found(best_at[long_enough], long_enough, best[long_enough])


def _rows(batch: pa.RecordBatch, block: Block) -> pa.Array:
    return batch.column(0).slice(block.first, block.n)


def find_leaks(documents: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, words inside an occurrence of an item window, items found, longest match."""
    spark = documents.sparkSession
    sent = [spark.sparkContext.broadcast(x) for x in item_blocks(items, window, block_words)]

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), SHARD_BYTES):
                words = block.spans(ALNUM, lower=True)
                hit = np.zeros(len(words), bool)
                longest = np.zeros(block.n, np.int64)
                listed: list[set] = [set() for _ in range(block.n)]
                for each in sent if len(words) else []:
                    found, best = Shard(words, each.value).search(each.value)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, found.at, 1)
                    np.add.at(edge, found.at + found.length, -1)
                    hit |= np.cumsum(edge[:-1]) > 0
                    np.maximum.at(longest, words.row[best.at], best.length)
                    pairs = np.unique(np.stack([words.row[found.at], each.value.item[found.suffix]]), axis=1)
                    for row, item in pairs.T.tolist():
                        listed[row].add(each.value.ids[item])
                names = [sorted(x for x in s if x is not None) for s in listed]
                n_hit = per_row(words.row[hit], block.n)
                yield pa.RecordBatch.from_arrays([
                    _rows(batch, block), int64(per_row(words.row, block.n)), int64(n_hit),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array(n_hit > 0), int64(longest)], names=[f.split()[0] for f in DIGEST_SCHEMA.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST_SCHEMA)


def longest_matches(documents: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim match of every test suffix in every shard, with its place (all lengths from a window up)."""
    spark = documents.sparkSession
    sent = [spark.sparkContext.broadcast(x) for x in item_blocks(items, window, block_words)]

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), SHARD_BYTES):
                words = block.spans(ALNUM, lower=True)
                size = per_row(words.row, block.n)
                first = np.cumsum(size) - size
                for each in sent if len(words) else []:
                    it = each.value
                    _, best = Shard(words, it).search(it)
                    row, item = words.row[best.at], it.item[best.suffix]
                    begin = np.searchsorted(it.item, item)
                    yield pa.RecordBatch.from_arrays([
                        _rows(batch, block).take(pa.array(row)), int64(best.at - first[row]),
                        pa.array([it.ids[i] for i in item.tolist()], pa.string()), int64(best.suffix - begin), int64(best.length)],
                        names=[f.split()[0] for f in MATCH_SCHEMA.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATCH_SCHEMA)


def remove_contaminated(documents: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, all columns as they were.

    Every row is judged on its own, so the row travels through the search
    whole, and neither ids nor texts have to be unique.
    """
    spark = documents.sparkSession
    sent = [spark.sparkContext.broadcast(x) for x in item_blocks(items, window, block_words)]
    text = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for block in blocks(batch.column(text).cast(pa.string()), SHARD_BYTES):
                words = block.spans(ALNUM, lower=True)
                for each in sent if len(words) else []:
                    found, _ = Shard(words, each.value).search(each.value)
                    clean[block.first + words.row[found.at]] = False
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(run, documents.schema)
