"""Spelling variants: k-d trees over letter-count vectors.

Words are counted by Spark.  One edit changes the letter counts of a word by a
distance (L1) of at most two: a replaced letter takes one from a count and adds
one to another, an inserted letter only adds one.  So the near words of a word
lie in a small box around its vector, and per pair of lengths (equal, or one
apart) the search is a range search in a k-d tree over the longer words:

* the top of each tree comes from a bounded sample (``SAMPLE_WORDS``) of the
  words of that length.  It only decides which words share a task.  Every word
  is a point of one cell and a query of every cell that its range reaches;
* in a task the tree goes on down to small leaves with tight boxes.  Batches of
  queries descend together and leave a branch once its box is out of range;
* in a leaf the order of letters decides: one edit leaves the first half of the
  shorter word or its other half as it was, so words meet by sorted hashes of
  halves, and are then compared letter by letter.

A cell that counts cannot split (anagrams) is cut by word hash instead, and its
queries go to every part, so a task holds about ``CELL_WORDS`` points whatever
the words are; queries pass through in batches.  Only counts per word and cell
leave a task, never pairs, so the rows written grow with words and cells.  A
variant's form occurs ten times as often, so chains of forms are at most as
long as the counts have digits and are followed by doubling.

Defined results: null or wordless texts have no words; a null id hashes as the
empty string; repeated rows count again; of near words with equal counts the
first in code-point order is the form; a word without near words has ``n_near``
0 and is its own root; an empty table gives no rows.  A very long run is a word
like any other.  Only the two named columns are read, whatever others there
are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.llm.storage import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form occurs so many times as often as its variant.
TIMES = 10
#: One run in so many loses a letter.
DROP_EVERY = 31
#: Letters share this many counts; sharing can only add candidates.
DIMS = 28
#: Points of a cell, points of a leaf, words the tops of all trees are built from.
CELL_WORDS, LEAF_WORDS, SAMPLE_WORDS = 32_768, 256, 200_000
#: Pairs compared at a time, in letters.
PAIR_LETTERS = 1 << 23
_BASE = np.uint64(0x9E3779B97F4A7C15)
SAME, LONGER = 1, 2


def counted_words(documents: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                  least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``(word, n)``: runs of letters, one in ``drop_every`` without one of its letters, that are long and frequent enough."""
    low = F.translate(F.col(f"`{text}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Shorter runs give no word, and greedy matches of longer ones are whole runs.
    runs = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    rows = documents.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = rows.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int")).select(
        F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= least_count)


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.array(words, f"<U{max(1, length)}").view(np.uint32).reshape(len(words), max(1, length))[:, :length]


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter-count vectors, a row per word."""
    n = len(letters)
    cell = np.arange(n)[:, None] * DIMS + letters % DIMS
    return np.bincount(cell.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


def plane(counts: np.ndarray) -> tuple[int, int] | None:
    """Count and bound that cut the vectors most evenly; None if they are all alike."""
    best, cut = None, 1.0
    lo, hi = counts.min(0), counts.max(0)
    for dim in np.flatnonzero(hi > lo):
        column = counts[:, dim]
        # The median, or the value below it where the median is the highest.
        middle = int(np.partition(column, len(column) // 2)[len(column) // 2])
        for bound in (middle, middle - 1):
            share = np.count_nonzero(column <= bound) / len(column)
            if 0 < share < 1 and abs(share - 0.5) < cut:
                best, cut = (int(dim), bound), abs(share - 0.5)
    return best


@dataclass
class Top:
    """Upper part of a tree: planes, with cells for leaves."""

    #: Of each node: dimension, bound, left and right node; or -1, first cell, number of cells, 0.
    nodes: list[tuple[int, int, int, int]] = field(default_factory=list)

    def cells(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """``(rows, first cell, cells)`` of the leaves that hold vectors at most ``up`` above and ``down`` below each row."""
        n = len(counts)
        zero = np.zeros(n, np.int32)
        stack = [(0, np.arange(n), zero, zero, np.zeros(DIMS, np.int64), np.full(DIMS, 1 << 30, np.int64))]
        while stack:
            node, rows, above, below, lo, hi = stack.pop()
            dim, bound, left, right = self.nodes[node]
            if dim < 0:
                yield rows, bound, left
                continue
            value = counts[rows, dim]
            # The distance to a box differs from that to its parent in one dimension only.
            under = below + np.maximum(value - bound, 0) - np.maximum(value - hi[dim], 0)
            over = above + np.maximum(bound + 1 - value, 0) - np.maximum(lo[dim] - value, 0)
            near = under <= down
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[dim], lo_right[dim] = bound, bound + 1
            if near.any():
                stack.append((left, rows[near], above[near], under[near], lo, hi_left))
            near = over <= up
            if near.any():
                stack.append((right, rows[near], over[near], below[near], lo_right, hi))


def build_top(sample: np.ndarray, total: int, first_cell: int, cell_words: int) -> tuple[Top, int]:
    """Top of the tree over ``total`` words of one length, and the next free cell number."""
    top, cell = Top(), first_cell
    stack: list[tuple[int, np.ndarray]] = [(0, np.arange(len(sample)))]
    top.nodes.append((-1, 0, 1, 0))
    scale = total / max(1, len(sample))
    while stack:
        node, rows = stack.pop()
        size = len(rows) * scale if len(sample) else total
        cut = plane(sample[rows]) if size > cell_words and len(rows) > 1 else None
        if cut is None:
            parts = max(1, math.ceil(size / cell_words))
            top.nodes[node] = (-1, cell, parts, 0)
            cell += parts
            continue
        dim, bound = cut
        left = sample[rows, dim] <= bound
        at = len(top.nodes)
        top.nodes[node] = (dim, bound, at, at + 1)
        top.nodes += [(-1, 0, 1, 0), (-1, 0, 1, 0)]
        stack += [(at, rows[left]), (at + 1, rows[~left])]
    return top, cell


def tops_of(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> dict[int, Top]:
    """A top per word length."""
    sizes = {r.length: r.words for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("words")).collect()}
    large = [length for length, size in sizes.items() if size > cell_words]
    samples = defaultdict(list)
    if large:
        # About ``sample_words`` words in all; which ones only moves the borders of cells.
        every = max(1, math.ceil(sum(sizes[x] for x in large) / sample_words))
        chosen = words.filter(F.col("length").isin(large) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0))
        for r in chosen.select("word", "length").collect():
            samples[r.length].append(r.word)
    tops, cell = {}, 0
    for length in sorted(sizes):
        sample = counts_of(letters_of(sorted(samples[length]), length)) if samples[length] else np.zeros((0, DIMS), np.int32)
        tops[length], cell = build_top(sample, sizes[length], cell, cell_words)
    return tops


_SENT = "cell long, kind int, length int, word string, n long"


def _router(tops: dict[int, Top]) -> Callable:
    """Words as points of their cell (kind 0) and as queries of the cells in range."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n")
            length = batch.column("length").to_numpy()
            part = batch.column("part").to_numpy()
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                counts = counts_of(letters_of([words[i] for i in rows], int(size)))
                for kind, target, up, down in ((0, size, 0, 0), (SAME, size, 1, 1), (LONGER, size + 1, 1, 0)):
                    if target not in tops:
                        continue
                    for found, first, parts in tops[target].cells(counts, up, down):
                        at = rows[found]
                        # A point goes to one part of its leaf, a query to all of them.
                        cells = [first + part[at] % parts] if kind == 0 else [np.full(len(at), first + k) for k in range(parts)]
                        for cell in cells:
                            take = pa.array(at)
                            yield pa.record_batch({
                                "cell": pa.array(cell.astype(np.int64)), "kind": pa.array(np.full(len(at), kind, np.int32)),
                                "length": pa.array(np.full(len(at), size, np.int32)), "word": batch.column("word").take(take),
                                "n": n.take(take)})

    return route


def _half_hash(letters: np.ndarray) -> np.ndarray:
    """Hash of each row; unequal rows of one hash are told apart later."""
    out = np.full(len(letters), letters.shape[1], np.uint64)
    for k in range(letters.shape[1]):
        out = (out ^ letters[:, k]) * _BASE
        out ^= out >> np.uint64(29)
    return out


class Cell:
    """The points of a cell as a k-d tree with tight boxes."""

    def __init__(self, words: list[str], n: np.ndarray, length: int):
        self.words, self.n, self.length = np.array(words, object), n, length
        self.letters = letters_of(words, length)
        order = np.argsort(np.array(words, f"<U{max(1, length)}"), kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        counts = counts_of(self.letters)
        #: Of each node: lowest and highest counts, children, points of a leaf.
        self.nodes: list[tuple[np.ndarray, np.ndarray, tuple[int, ...], np.ndarray | None]] = []
        stack = [(np.arange(len(words)), None)]
        while stack:
            rows, parent = stack.pop()
            here = counts[rows]
            cut = plane(here) if len(rows) > LEAF_WORDS else None
            at = len(self.nodes)
            self.nodes.append((here.min(0), here.max(0), (), rows if cut is None else None))
            if parent is not None:
                lo, hi, children, _ = self.nodes[parent]
                self.nodes[parent] = (lo, hi, (*children, at), None)
            if cut is not None:
                left = here[:, cut[0]] <= cut[1]
                stack += [(rows[left], at), (rows[~left], at)]
        self.halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def leaves(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(queries, points)`` of every leaf in range of some queries."""
        stack = [(0, np.arange(len(counts)))]
        while stack:
            node, rows = stack.pop()
            lo, hi, children, points = self.nodes[node]
            here = counts[rows]
            near = (np.maximum(lo - here, 0).sum(1) <= up) & (np.maximum(here - hi, 0).sum(1) <= down)
            rows = rows[near]
            if len(rows) and points is not None:
                yield rows, points
            elif len(rows):
                stack += [(child, rows) for child in children]

    def half_hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the halves that words of ``length`` letters may share with the points."""
        if length not in self.halves:
            first, last = length // 2, length - length // 2
            self.halves[length] = _half_hash(self.letters[:, :first]), _half_hash(self.letters[:, self.length - last:])
        return self.halves[length]

    def near(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(queries, points)`` exactly one edit apart, every pair once."""
        length = letters.shape[1]
        same = length == self.length
        own = _half_hash(letters[:, :length // 2]), _half_hash(letters[:, length // 2:])
        theirs = self.half_hashes(length)
        for rows, points in self.leaves(counts_of(letters), 1, int(same)):
            for half in (0, 1):
                order = points[np.argsort(theirs[half][points], kind="stable")]
                keys, wanted = theirs[half][order], own[half][rows]
                begin = np.searchsorted(keys, wanted, "left")
                many = np.searchsorted(keys, wanted, "right") - begin
                hit = np.flatnonzero(many)
                at, step = 0, max(1, PAIR_LETTERS // max(1, length))
                ends = np.cumsum(many[hit])
                while at < len(hit):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
                    some, at = hit[at:to], to
                    q = np.repeat(some, many[some])
                    inside = np.arange(len(q)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
                    p, q = order[begin[q] + inside], rows[q]
                    if half:
                        # Equal first halves have met already.
                        new = own[0][q] != theirs[0][p]
                        p, q = p[new], q[new]
                    good = self._one_edit(letters[q], self.letters[p], same)
                    if good.any():
                        yield q[good], p[good]

    @staticmethod
    def _one_edit(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
        if same:
            return (a != b).sum(1) == 1
        n = a.shape[1]
        equal = a == b[:, :n]
        prefix = np.where(equal.all(1), n, np.argmin(equal, 1)) if n else np.zeros(len(a), np.int64)
        return ((a == b[:, 1:]) | (np.arange(n) < prefix[:, None])).all(1)


_FOUND = "word string, n_near long, form_n long, form string"


def _summary(of: np.ndarray, other: np.ndarray, words: np.ndarray, other_words: np.ndarray, other_n: np.ndarray,
             other_rank: np.ndarray) -> pa.RecordBatch:
    """Per word its number of partners, and the most frequent one."""
    order = np.lexsort((other_rank[other], -other_n[other], of))
    of, other = of[order], other[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return pa.record_batch({
        "word": pa.array(words[of[first]], pa.string()), "n_near": pa.array(np.diff(np.append(first, len(of))).astype(np.int64)),
        "form_n": pa.array(other_n[other[first]]), "form": pa.array(other_words[other[first]], pa.string())})


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by (cell, kind, length): the points of a cell, then its queries."""
    at, tree, points, n = None, None, [], []
    for batch in batches:
        cell, kind, length = (batch.column(c).to_numpy() for c in ("cell", "kind", "length"))
        words, many = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0) | (np.diff(length) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(cell)]):
            if hi == lo:
                continue
            if cell[lo] != at:
                at, tree, points, n = cell[lo], None, [], []
            if kind[lo] == 0:
                points += words[lo:hi]
                n.append(many[lo:hi])
                continue
            if not points:
                continue
            if tree is None:
                tree = Cell(points, np.concatenate(n), len(points[0]))
            asked, asked_n = words[lo:hi], many[lo:hi]
            pairs = list(tree.near(letters_of(asked, int(length[lo]))))
            if not pairs:
                continue
            q, p = (np.concatenate(x) for x in zip(*pairs))
            own = np.array(asked, object)
            yield _summary(q, p, own, tree.words, tree.n, tree.rank)
            if kind[lo] == LONGER:
                # Words of one length find each other from both sides; here only the shorter one asks.
                rank = np.empty(len(asked), np.int64)
                rank[np.argsort(np.array(asked), kind="stable")] = np.arange(len(asked))
                yield _summary(p, q, tree.words, own, asked_n, rank)


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``(word, n_near, near, near_n)`` of every word of ``words(word, n)`` with near words: their number and the most frequent."""
    sized = words.select("word", "n", F.length("word").alias("length"), F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1 << 30)).alias("part"))
    tops = tops_of(sized, cell_words, sample_words)
    sent = sized.mapInArrow(_router(tops), _SENT)
    found = sent.repartition("cell").sortWithinPartitions("cell", "kind", "length").mapInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots_of(forms: DataFrame, steps: int) -> DataFrame:
    """``(word, root)``: the end of each word's chain in ``forms(word, form)``, chains having at most ``steps`` steps."""
    chain = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        later = chain.select(F.col("word").alias("root"), F.col("root").alias("later"))
        chain = stored(chain.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root")), "roots")
    return chain


def spelling_groups(words: DataFrame, times: int = TIMES, **options) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``words(word, n)``."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    most = words.agg(F.max("n")).first()[0] or 1
    near = near_words(words, **options)
    good = F.col("near_n") >= times * F.col("n")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"),
        F.when(good, F.col("near_n")).alias("form_n")), "spelling")
    forms = judged.filter("form IS NOT NULL").select("word", "form")
    # Counts grow ``times``-fold with every step.
    roots = roots_of(forms, max(1, math.ceil(math.log(most, times))) if times > 1 else 64)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
