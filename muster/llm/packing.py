"""Best-fit packing by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens.  Pieces of one length
are interchangeable, so the packing is decided on the histogram of lengths, at
most ``capacity`` numbers, whatever the size of the input:

1. The linear program has one variable per configuration (a multiset of
   lengths that fits).  Multiplicative weights raise the weight of lengths that
   lag behind in coverage, and a knapsack dynamic programme finds the
   configuration of the largest weight.
2. The program's solution is rounded down to whole sequences, never beyond
   what is there, fullest configurations first.
3. The rest of the histogram goes best fit, longest first, into sequences
   grouped by the space left.  Best fit alone is tried as well, and the packing
   with the fewest sequences counts.

Pieces are then numbered inside their length (counts per hash bucket, prefix
sums, ranks inside buckets), and a small table of rank ranges gives each its
sequence and offset.

Defined results: null and empty texts are one separator; equal rows are packed
one by one; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from muster.llm.storage import stored
from muster.llm.tokenize import encoder
from muster.llm.words import blocks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS_PER_BUCKET = 100_000


def token_pieces(documents: DataFrame, vocabulary: str, *, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` ids, the separator last."""
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, counts = encode.encode(block)
                ends = np.cumsum(counts)
                docs = batch.column(0).slice(block.first, block.n).to_pylist()
                rows = []
                for doc, lo, hi in zip(docs, (ends - counts).tolist(), ends.tolist()):
                    own = np.append(ids[lo:hi], np.uint32(separator)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        rows.append((doc, k, start, len(part), zlib.crc32(part)) + ((part.tolist(),) if with_ids else ()))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_configuration(lengths: np.ndarray, worth: np.ndarray, capacity: int, limit: np.ndarray) -> dict[int, int]:
    """Knapsack over lengths by dynamic programming; counts stay within ``limit``."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for space in range(int(lengths[0]), capacity + 1):
        n = bisect_left(lengths, space + 1)
        total = value[space - lengths[:n]] + worth[:n]
        k = int(np.argmax(total))
        if total[k] > value[space - 1]:
            value[space], choice[space] = total[k], k
        else:
            value[space], choice[space] = value[space - 1], -1
    out: dict[int, int] = {}
    space = capacity
    while space > 0:
        k = int(choice[space])
        if k < 0:
            space -= 1
        else:
            out[k] = out.get(k, 0) + 1
            space -= int(lengths[k])
    return {k: min(a, int(limit[k])) for k, a in out.items()}


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float) -> dict[tuple, float]:
    """Configurations and how often each is used, by multiplicative weights."""
    weight = lengths / capacity
    done = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        lag = done / counts
        open_ = lag < 1
        if not open_.any():
            break
        price = np.where(open_, weight * np.exp(-step * lag), 0.0)
        found = best_configuration(lengths, price, capacity, np.maximum(1, counts))
        found = {k: a for k, a in found.items() if open_[k]}
        if not found:
            break
        amount = min((counts[k] - done[k]) / a for k, a in found.items())
        amount = max(amount / 2, min(amount, 1.0))
        key = tuple(sorted(found.items()))
        used[key] = used.get(key, 0.0) + amount
        for k, a in found.items():
            done[k] += a * amount
    return used


def plan(histogram: dict[int, int], capacity: int, *, rounds: int = 400, step: float = 3.0) -> list[tuple[int, dict[int, int]]]:
    """``(how many, {length: pieces})`` for all sequences of a packing.

    The program's solution is rounded in two ways (all configurations, or only
    those that leave no more than a thousandth empty) and best fit completes
    each; plain best fit is the third packing.  The shortest of them counts, the
    program's own on a tie, so the program never costs a sequence.
    """
    left = {l: n for l, n in histogram.items() if n > 0}
    full = [(left.pop(capacity), {capacity: 1})] if capacity in left else []
    if not left:
        return full
    lengths = np.array(sorted(left))
    counts = np.array([left[int(l)] for l in lengths], float)
    used = fractional(lengths, counts, capacity, rounds, step)
    packings = [*(_rounded(used, lengths, left, capacity, least) for least in (0.999, 0.0)), _best_fit(left, capacity)]
    return full + min(packings, key=lambda packing: sum(many for many, _ in packing))


def _rounded(used: dict[tuple, float], lengths: np.ndarray, histogram: dict[int, int], capacity: int, least: float) -> list[tuple[int, dict[int, int]]]:
    """Whole sequences of the configurations filled to ``least``, fullest first, and best fit for the rest."""
    left, out = dict(histogram), []
    fill = lambda c: sum(int(lengths[k]) * a for k, a in c)
    for config, amount in sorted(used.items(), key=lambda x: (-fill(x[0]), x[0])):
        parts = {int(lengths[k]): a for k, a in config}
        times = min(int(amount + 1e-9), *(left[l] // a for l, a in parts.items()))
        if times and fill(config) >= capacity * least:
            out.append((times, parts))
            for l, a in parts.items():
                left[l] -= a * times
    return out + _best_fit({l: n for l, n in left.items() if n}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Longest first, each length into the fullest sequences that still take it; equal sequences move together."""
    groups: dict[int, list[list]] = {}
    spaces: list[int] = []

    def put(space: int, many: int, parts: dict[int, int]) -> None:
        if space not in groups:
            groups[space] = []
            spaces.insert(bisect_left(spaces, space), space)
        groups[space].append([many, parts])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, n // each, {length: each})
                    n %= each
                else:
                    put(capacity - n * length, 1, {length: n})
                    n = 0
                continue
            space = spaces[at]
            many, parts = groups[space].pop()
            if not groups[space]:
                del groups[space]
                spaces.pop(at)
            each = min(space // length, n)
            times = min(many, n // each)
            if times < many:
                put(space, many - times, parts)
            put(space - each * length, times, {**parts, length: parts.get(length, 0) + each})
            n -= each * times
    return [(many, parts) for space in sorted(groups) for many, parts in groups[space]]


def _ranges(packing: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, first sequence, pieces per sequence, offset)``."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for many, parts in packing:
        offset = 0
        for length, each in sorted(parts.items(), reverse=True):
            first = next_rank.get(length, 0)
            next_rank[length] = first + each * many
            rows.append((length, first, next_rank[length], sequence, each, offset))
            offset += each * length
        sequence += many
    return rows


def pack(pieces: DataFrame, *, capacity: int = 2048, rounds: int = 400) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``pieces`` should be a written table."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows.
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    buckets = max(16, sum(histogram.values()) // ROWS_PER_BUCKET)
    ranges = spark.createDataFrame(_ranges(plan(histogram, capacity, rounds=rounds)) or [(0, 0, 0, 0, 1, 0)],
                                   "length long, first long, end long, sequence long, each long, at long")
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "_bucket").count().select(
        "length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    # A few rows per length and at most a few times capacity in all.
    found = ranked.join(F.broadcast(ranges), "length").filter("_rank >= first and _rank < end")
    turn = F.col("_rank") - F.col("first")
    return found.select(
        *pieces.columns, (F.col("sequence") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (turn % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(documents: DataFrame, vocabulary: str, *, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Tokenize, cut and pack; one row per piece."""
    return pack(stored(token_pieces(documents, vocabulary, capacity=capacity, separator=separator), "pieces"), capacity=capacity)
