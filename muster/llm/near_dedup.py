"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct word shingles; the sketch keeps the ``k``
smallest hashes.  Documents with equal sets are one class and only its first
document goes on.  Inverted lists of retained values bring documents together.
A set of more than ``k`` shingles lists its retained values by neighbouring
twos, in hash order: one value of a frequent shingle is held by a share of all
documents, two of them side by side by hardly any but near copies.  A smaller
set lists its rarest values (by a count sketch), as many as any partner must
share; sets that can link with both kinds list both.  Within a list, large sets are
compared by two bits of the smallest value in each of 64 bins; sets of at most
``MAPPED`` shingles also by a bit map of the whole set, which bounds what two
sets can share, so that documents with a long passage in common and little else
leave no pair.  The sketch of
the union estimates the similarity of pairs, and the exact Jaccard of the whole
sets decides.  Links are closed to components.

Of the ``k`` = 24 smallest values of the union of two sets at similarity 0.8
each is shared with probability 0.8: no two side by side are shared with
probability 2e-7, fewer than ``least`` = 8 with 2e-7.  A bin agrees with
probability 0.85, fewer than 38 of 64 do with 2e-7.  Pairs with a set of at most
``k`` shingles are compared without that risk.

Defined results: null, empty and wordless texts have no set and stand alone; a
text with fewer words than a shingle is one shingle of all its words; a null id
stands alone and is kept; rows with equal ids are one node, kept or not
together; empty tables give empty tables; long texts are read whole; other
columns, whatever their names, are ignored by ``near_duplicates`` and pass
through ``keep_first``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.llm.components import component_of
from muster.llm.setjoin import (CountSketch, PAIR, Part, ROWS, STAR, bit_counts, candidates, dealt, distinct_in_rows, packed, row_sums, signature,
                                verified, wide_signature)
from muster.llm.storage import free_name, stored
from muster.llm.words import Block, NOT_SPACE, U64, blocks, int64, mix, per_row, span_hashes, windows

K, LEAST = 24, 8
#: Bins of 64 that agree at least.
AGREE = 38
#: Listed single values that two similar sets share at least (equal sets aside, sets of four shingles are the smallest that can be linked).
SHARED = 2
BINS = 1 << 16
#: Larger sets fill a map of 256 bits too far to tell them apart.
MAPPED = 192
MAPS = [f"map_{i}" for i in range(4)]
_MAPS = ", ".join(f"{m} long" for m in MAPS)
LISTED = f"{ROWS}, more_bits long, {_MAPS}"
SKETCHES = f"doc_id long, n_shingles long, print_a long, print_b long, minima long, minima_too long, {_MAPS}, sketch array<long>"


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all shingles; a shorter text is one shingle."""
    words = block.spans(NOT_SPACE, lower=True)
    at, key = windows(words, size)
    count = per_row(words.row, block.n)
    short = np.flatnonzero((count > 0) & (count < size))
    first = (np.cumsum(count) - count)[short]
    return np.append(words.row[at], short), np.append(key, mix(span_hashes(words.hash, first, first + count[short]) + count[short].astype(U64)))


def bin_minima(row: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    """Two bits of the smallest value in each of 64 bins, 0 where a bin is empty; values sorted by row."""
    drawn = mix(value ^ U64(0x2545F4914F6CDD1D))
    bits = np.zeros(n * 64, np.uint8)
    # The last of several writes to a place holds, and that is the smallest value.
    bits[(row * 64 + (drawn >> U64(58)).astype(np.int64))[::-1]] = (drawn & U64(3)).astype(np.uint8)[::-1]
    return [np.packbits(bits & 1).view(U64), np.packbits(bits >> 1).view(U64)]


def sketches(documents: DataFrame, size: int = 2, k: int = K) -> DataFrame:
    """Size, fingerprint and bottom-k sketch of every document's set."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, value = distinct_in_rows(*shingles(block, size))
                count = per_row(row, block.n)
                place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                low = place < k
                mapped = (count <= MAPPED)[row]
                maps = wide_signature(row[mapped], value[mapped], np.full(block.n, 4))
                offsets = np.append(0, np.cumsum(np.minimum(count, k))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first, block.n), int64(count), int64(row_sums(row, mix(value), block.n)),
                    int64(row_sums(row, mix(value * U64(3)), block.n)), *map(int64, bin_minima(row, value, block.n)), *map(int64, maps), pa.ListArray.from_arrays(pa.array(offsets), int64(value[low]))],
                    names=[f.split()[0] for f in SKETCHES.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCHES)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of a column of lists."""
    size = column.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(column)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), column.flatten().to_numpy().view(U64)


def _listed(n: np.ndarray, sketch: pa.Array, k: int, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and value of the single retained values that may be listed, row and key of the neighbouring twos."""
    row, _, value = _flat(sketch)
    single = (n * ratio[0] <= k * ratio[1])[row]
    twice = np.flatnonzero((row[1:] == row[:-1]) & (n > k)[row[1:]])
    return row[single], value[single], row[twice], mix(value[twice] + mix(value[twice + 1]))


def listed_values(reps: DataFrame, ratio: tuple[int, int], k: int = K) -> DataFrame:
    """Rows of the inverted lists: neighbouring twos of retained values, the rarest values of small sets."""
    counter = CountSketch(BINS)

    def values(batch):
        _, value, _, key = _listed(batch.column(0).to_numpy(), batch.column(1), k, ratio)
        return [value, key]

    counts = counter.collect(reps.select("n_shingles", "sketch"), values)
    sent = reps.sparkSession.sparkContext.broadcast(counts)
    # What other values of a bin add on average does not make a value hot.
    usual = int(counts.mean())

    def run(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            row, value, of, key = _listed(n, batch.column(2), k, ratio)
            kept = np.minimum(n, k)
            # What a partner shares at least, less what the sketches of both may have cut off.
            cut = np.where(n > k, n - k, np.where(n * ratio[1] >= k * ratio[0], k * (ratio[1] - ratio[0]) // ratio[0], 0))
            need = np.clip(-(-ratio[0] * n // ratio[1]) - cut, 1, np.maximum(kept, 1))
            seen = sent.value[counter.bin_of(value)]
            order = np.lexsort((value, seen, row))
            held = np.bincount(row, minlength=len(n))
            rank = np.arange(len(row)) - (np.cumsum(held) - held)[row]
            chosen = order[rank < (kept - need + SHARED)[row]]
            all_row, _, all_value = _flat(batch.column(2))
            bits = signature(all_row, all_value, len(n))
            bits = np.append(bits[row[chosen]], batch.column(4).to_numpy().view(U64)[of])
            too = np.append(np.zeros(len(chosen), U64), batch.column(5).to_numpy().view(U64)[of])
            row, value = np.append(row[chosen], of), np.append(value[chosen], key)
            expected = np.maximum(1, sent.value[counter.bin_of(value)] - usual)
            at, key = dealt(value, expected, row.astype(U64) + U64(1))
            bits, too, at = bits[at], too[at], row[at]
            mark = (batch.column(3).to_numpy()[at] >> 32).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                int64(key), int64(bits), packed(mark, np.zeros(len(at), np.int32)), batch.column(0).take(pa.array(at)),
                packed(n[at], kept[at]), int64(too), *(batch.column(m).take(pa.array(at)) for m in MAPS)],
                names=[f.split()[0] for f in LISTED.split(", ")])

    return reps.select("doc_id", "n_shingles", "sketch", "print_a", "minima", "minima_too", *MAPS).mapInArrow(run, LISTED)


def estimated(found: DataFrame, reps: DataFrame, ratio: tuple[int, int], k: int = K, least: int = LEAST) -> DataFrame:
    """Pairs whose union sketch does not rule them out; stars stay whole."""
    own = reps.select("doc_id", "sketch", "n_shingles")
    pairs = found.filter(F.col("kind") == PAIR).join(own.select(F.col("doc_id").alias("doc"), F.col("sketch").alias("_s"), F.col("n_shingles").alias("_n")), "doc").join(
        own.select(F.col("doc_id").alias("hub_doc"), F.col("sketch").alias("_t"), F.col("n_shingles").alias("_m")), "hub_doc")
    common = F.size(F.array_intersect("_s", "_t"))
    small = F.greatest("_n", "_m") <= k
    exact = common * ratio[1] >= (F.col("_n") + F.col("_m") - common) * ratio[0]
    passed = pairs.filter(F.when(small, exact).otherwise(common >= F.least(F.lit(least), F.least("_n", "_m") * ratio[0] / ratio[1])))
    return found.filter(F.col("kind") == STAR).unionByName(passed.select(*found.columns))


def near_duplicates(documents: DataFrame, *, size: int = 2, ratio: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: linked where ``ratio[1] * common >= ratio[0] * union``.

    A ratio below 80 in 100 is refused: the lengths of sketches and the filters
    on them (``K``, ``LEAST``, ``AGREE``) would lose links there.
    """
    if ratio[0] * 100 < 80 * ratio[1] or ratio[0] > ratio[1]:
        raise ValueError("near duplicates are found at ratios from 80 in 100 to 1")
    made = stored(sketches(documents, size), "sketches")
    sets = made.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "print_a", "print_b"]
    classes = stored(sets.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    # The first document of a class carries its sketch on.
    reps = stored(sets.join(classes, same).filter("doc_id = rep").dropDuplicates(["doc_id", *same]).select("doc_id", "n_shingles", "sketch", "print_a", "minima", "minima_too", *MAPS), "reps")

    def agree(a: Part, b: Part) -> np.ndarray:
        return 64 - bit_counts((a["bits"] ^ b["bits"]) | (a["more_bits"] ^ b["more_bits"])) >= AGREE

    def common(a: Part, b: Part) -> np.ndarray:
        # Values of one set that fall on the same bit may hide shared ones.
        return bit_counts(a["bits"] & b["bits"]) + np.minimum(a["place"] - bit_counts(a["bits"]), b["place"] - bit_counts(b["bits"]))

    def large(a: Part, b: Part) -> np.ndarray:
        """Both are in lists of twos, with bin minima as their bits."""
        return np.minimum(a["n"], b["n"]) > K

    def by_maps(a: Part, b: Part) -> np.ndarray:
        """Whether the shingles that one map has and the other lacks leave enough in common."""
        a_only, b_only = (sum(bit_counts(x[m] & ~y[m]) for m in MAPS) for x, y in ((a, b), (b, a)))
        most = np.minimum(a["n"] - a_only, b["n"] - b_only)
        return (ratio[0] + ratio[1]) * most >= ratio[0] * (a["n"].astype(np.int64) + b["n"])

    def near(a: Part, b: Part) -> np.ndarray:
        fewer = np.minimum(a["n"], b["n"]).astype(np.int64)
        need = np.clip(fewer * ratio[0] // ratio[1] - K * (ratio[1] - ratio[0]) // ratio[0], 1, LEAST)
        fits = ratio[1] * fewer >= ratio[0] * np.maximum(a["n"], b["n"])
        ok = fits & np.where(large(a, b), agree(a, b), common(a, b) >= need)
        mapped = np.flatnonzero(ok & (np.maximum(a["n"], b["n"]) <= MAPPED))
        ok[mapped] = by_maps(a.of(mapped), b.of(mapped))
        return ok

    def star(a: Part, b: Part) -> np.ndarray:
        alike = bit_counts(a["bits"] & b["bits"]) * 2 >= np.minimum(bit_counts(a["bits"]), bit_counts(b["bits"]))
        return np.where(large(a, b), agree(a, b), alike) & (2 * np.minimum(a["n"], b["n"]).astype(np.int64) >= np.maximum(a["n"], b["n"]))

    # One list of twos is evidence enough.
    shared = F.when(F.col("n") > K, 1).otherwise(SHARED)
    found = stored(estimated(stored(candidates(listed_values(reps, ratio), near, star, ratio, shared), "candidates"), reps, ratio), "found")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("unit")).filter("doc is not null")
    links = verified(found, texts, ["doc"], lambda block: shingles(block, size), ratio, forest=True)
    # Rows of one id are one node.
    twice = sets.join(classes, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    labels = component_of(links.select(F.col("doc").alias("a"), F.col("other_doc").alias("b")).union(twice))
    out = made.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(documents: DataFrame, **options) -> DataFrame:
    """The documents that are the first of their component, all columns as they were."""
    name = free_name(documents, "_gone")
    gone = near_duplicates(documents, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
