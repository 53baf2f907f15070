"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, ordered by rarity: by the count sketch
over all lines, then by hash.  Two lines at Jaccard ``t`` must share two of
their first ``n - ceil(t * n) + 2`` tokens, so only these are listed, and pairs
that meet in one list only are dropped.  Pairs of
a list pass length, position and signature filters (bit maps of 64 bits, more
for long lines, whose map would be too full), whole token sets decide,
and the later line of a match goes.  Every line is judged on the input: it goes
if any earlier line, kept or not, matches it.  Lines with equal token sets meet
by fingerprint and need no texts.

Defined results: null texts have no lines and stay null; lines of fewer than
``least_words`` words (5) are never judged and stay; rows with a null id stay
as they are; rows with equal ids share their numbering, so an equal line at an
equal place in both is no earlier line; empty tables give empty tables; other
columns, whatever their names, pass through.  Lines are cut once per document,
and only those that are compared move, looked up by ``(doc, line)``, so the work
is linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from muster.llm.setjoin import ROWS, SAME, CountSketch, Part, bit_counts, candidates, dealt, order_by, packed, row_sums, verified, wide_signature
from muster.llm.storage import column, free_name, stored
from muster.llm.words import NOT_LF, NOT_SPACE, U64, Block, blocks, int64, mix

BINS = 1 << 20
#: Listed tokens that two matching lines share at least.
SHARED = 2
#: Lines of more tokens have two and four bit maps.
TWO, FOUR = 72, 144
LISTED = f"{ROWS}, wide_1 long, wide_2 long, wide_3 long"


def line_words(block: Block, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(unit, hash)`` of all words of the lines long enough, and row and line number of the units."""
    feeds = np.flatnonzero(~NOT_LF[block.data])
    words = block.spans(NOT_SPACE)
    # Lines are numbered through the block: feeds and row starts before a word.
    line = np.searchsorted(feeds, words.starts) + words.row
    found, unit = np.unique(line, return_inverse=True)
    long_enough = np.bincount(unit, minlength=len(found)) >= least
    row = np.zeros(len(found), np.int64)
    row[unit] = words.row
    number = found - row - np.searchsorted(feeds, block.offsets[:-1])[row]
    new = np.cumsum(long_enough) - 1
    keep = long_enough[unit]
    return new[unit[keep]], words.hash[keep], row[long_enough], number[long_enough]


def maps_of(n: np.ndarray) -> np.ndarray:
    """How many bit maps lines of ``n`` tokens have."""
    return np.where(n > FOUR, 4, np.where(n > TWO, 2, 1))


def map_sums(a: Part, b: Part, told: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Bits that ``told(x, y)`` leaves of the maps of two lines, on as many maps as both have; and how many those are."""
    maps = np.minimum(maps_of(a["n"]), maps_of(b["n"]))
    total = bit_counts(told(a["bits"], b["bits"]))
    # The long lines that the folded maps do not tell apart are few.
    for many, folds in ((2, ((0, 2), (1, 3))), (4, ((0,), (1,), (2,), (3,)))):
        at = np.flatnonzero(maps == many)
        x, y = a.of(at), b.of(at)
        total[at] = sum(bit_counts(told(np.bitwise_or.reduce([x[f"wide_{k}"] for k in fold]), np.bitwise_or.reduce([y[f"wide_{k}"] for k in fold]))) for fold in folds)
    return total, maps


def listed_tokens(documents: DataFrame, ratio: tuple[int, int], least: int, bins: int = BINS) -> DataFrame:
    """Rows of the inverted lists: the rarest tokens of every line."""
    counter = CountSketch(bins)

    def tokens(batch):
        for block in blocks(batch.column(0)):
            # Repeats within a line count as well: any order that all lines share is complete.
            yield line_words(block, least)[1]

    counts = counter.collect(documents.select("text"), tokens)
    sent = documents.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    # What other tokens of a bin add on average does not make a token hot.
    usual = int(counts.mean())

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                unit, value, row, number = line_words(block, least)
                seen = sent.value[counter.bin_of(value)]
                order = order_by(unit, seen, value)
                unit, value, seen = unit[order], value[order], seen[order]
                new = np.append(True, (unit[1:] != unit[:-1]) | (value[1:] != value[:-1])) if len(unit) else np.zeros(0, bool)
                unit, value, seen = unit[new], value[new], seen[new]
                n = np.bincount(unit, minlength=len(row)).astype(np.int64)
                rank = np.arange(len(unit)) - (np.cumsum(n) - n)[unit]
                chosen = np.flatnonzero(rank < (n - -(-ratio[0] * n // ratio[1]) + SHARED)[unit])
                bits, mark = wide_signature(unit, value, maps_of(n)), row_sums(unit, mix(value), len(row))
                at, key = dealt(value[chosen], np.maximum(1, seen[chosen] - usual), mark[unit[chosen]])
                of, place = unit[chosen][at], rank[chosen][at]
                yield pa.RecordBatch.from_arrays([
                    int64(key), int64(bits[0][of]), packed((mark[of] >> U64(32)).astype(np.uint32).view(np.int32), number[of]),
                    batch.column(0).slice(block.first, block.n).take(pa.array(row[of])), packed(n[of], place),
                    *(int64(more[of]) for more in bits[1:])], names=[f.split()[0] for f in LISTED.split(", ")])

    return documents.select("doc", "text").mapInArrow(run, LISTED)


def compared_lines(named: DataFrame, compared: DataFrame) -> DataFrame:
    """``(doc, line, unit)`` of the lines in ``compared``: no other line is moved."""
    wanted = compared.select("doc", "line").union(compared.select("hub_doc", "hub_line")).groupBy("doc").agg(F.collect_set("line").alias("lines"))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, numbers in zip(*(column.to_pylist() for column in batch.columns)):
                units = text.split(b"\n") if text is not None else []
                # Another row of the same id may have fewer lines.
                rows += [(doc, line, units[line]) for line in numbers if line < len(units)]
            doc, line, unit = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(unit, pa.binary()).view(pa.string())], names=["doc", "line", "unit"])

    # Both grow with the input; the texts move by document, as they do for the result.
    return named.join(wanted.hint("merge"), "doc").select("doc", F.col("text").cast("binary"), "lines").mapInArrow(cut, "doc long, line int, unit string")


def later_lines(documents: DataFrame, *, ratio: tuple[int, int] = (80, 100), least_words: int = 5) -> DataFrame:
    """``(doc, line)`` of every line that has an earlier match; lines count from 0."""
    named = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc is not null")

    def reaches(a: Part, b: Part, common: np.ndarray) -> np.ndarray:
        return (ratio[0] + ratio[1]) * common.astype(np.int64) >= ratio[0] * (a["n"].astype(np.int64) + b["n"])

    def lacking(a: Part, b: Part) -> np.ndarray:
        """How many tokens of ``a`` are not in ``b``, at least."""
        return map_sums(a, b, lambda x, y: x & ~y)[0]

    def near(a: Part, b: Part) -> np.ndarray:
        ahead = np.minimum(a["place"], b["place"])
        behind = np.minimum(a["n"] - a["place"], b["n"] - b["place"])
        folded = np.minimum(a["n"] - bit_counts(a["bits"] & ~b["bits"]), b["n"] - bit_counts(b["bits"] & ~a["bits"]))
        ok = reaches(a, b, np.minimum(folded, ahead + behind))
        left = np.flatnonzero(ok)
        x, y = a.of(left), b.of(left)
        ok[left] = reaches(x, y, np.minimum(x["n"] - lacking(x, y), y["n"] - lacking(y, x)))
        return ok

    def alike(a: Part, b: Part) -> np.ndarray:
        """Signatures clearly nearer than those of unrelated lines, or too full to tell."""
        differing, maps = map_sums(a, b, lambda x, y: x ^ y)
        free = np.exp(-(a["n"] + b["n"]) / (128 * maps))
        return differing <= 64 * maps * free * (1 - free) + 2

    found = stored(candidates(listed_tokens(named, ratio, least_words), near, alike, ratio, SHARED), "line_candidates")

    def sets(block: Block):
        words = block.spans(NOT_SPACE)
        return words.row, words.hash

    compared = found.filter(F.col("kind") != SAME)
    links = verified(compared, compared_lines(named, compared), ["doc", "line"], sets, ratio, later=True)
    here, there = F.struct("doc", "line"), F.struct(F.col("other_doc").alias("doc"), F.col("other_line").alias("line"))
    later = links.select(F.greatest(here, there).alias("x")).select("x.doc", "x.line")
    return found.filter(F.col("kind") == SAME).select("doc", "line").union(later).distinct()


def _removed(documents: DataFrame, **options) -> DataFrame:
    return later_lines(documents, **options).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("_gone"))


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers; null where either is null."""

    def left(t, numbers):
        if t is None or numbers is None:
            return None
        lines = np.array(t.split("\n"), object)
        keep = np.ones(len(lines), bool)
        keep[np.asarray(numbers, int)] = False
        return "\n".join(lines[keep])

    return pd.Series([left(t, n) for t, n in zip(text, gone)], dtype=object)


def drop_later_lines(documents: DataFrame, *, drop_emptied: bool = False, **options) -> DataFrame:
    """The documents without lines that match an earlier one; ``n_chars`` follows the text if there is one.

    ``drop_emptied`` leaves out documents of which no word is left.
    """
    doc, gone, left = (free_name(documents, n) for n in ("_doc", "_gone", "_left"))
    removed = _removed(documents, **options).toDF(doc, gone)
    joined = documents.join(removed, F.col("doc_id").cast("long") == F.col(doc), "left")
    whole = F.col(gone).isNull()
    out = joined.withColumn(left, F.when(whole, F.col("text").cast("string")).otherwise(without_lines(F.when(~whole, F.col("text").cast("string")), F.col(gone))))
    if drop_emptied:
        out = out.filter(whole | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col(left)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(left)).cast(documents.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, column(c)).alias(c) for c in documents.columns])


def line_report(documents: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept_sha256)`` per document."""
    # The same table as the search reads, so that Spark moves it once.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    named = texts.filter("doc is not null")
    joined = named.join(_removed(documents, **options), "doc", "left").select("doc", "text", "_gone").unionByName(
        texts.filter("doc is null").withColumn("_gone", F.lit(None).cast("array<int>")))
    lines = F.split("text", "\n")
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(without_lines(F.when(F.col("_gone").isNotNull(), F.col("text")), F.col("_gone")))
    return joined.select(F.col("doc").alias("doc_id"), F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
                         F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).cast("long").alias("n_removed"),
                         F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))
