"""Substring dedup by recompression.

Words are level 0.  Maximal runs of a word are named, then rounds of pair
compression follow: a hash of its name puts every symbol on one of two sides,
and a left symbol followed by a right one becomes a new symbol.  Names are
fingerprints of what they stand for, so all tasks give equal substrings equal
interior symbols without exchanging a table of names.  With every symbol goes
the stretch of words its forming depended on; equal windows that hold this
stretch hold the symbol.

1. Symbols whose stretch fits in a window are counted over the corpus.  One
   that occurs once shows every window around its stretch to be new.
2. The windows left are looked at exactly: the least ``doc_id`` per window
   fingerprint (96 bits).  Only the first document of a window hears of it, so
   no message depends on how often a window occurs.
3. All windows of a candidate stretch that are not first go, and the words they
   cover.  Copies of a whole document are told by one fingerprint per document
   and send no windows.

Defined results: null has no words; texts of fewer words than a window keep
everything; rows with equal ids count as one document for "earlier", each row
keeping the first place of a window in itself; rows with a null id are kept as
they are and make nothing else repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.llm.storage import stored
from muster.llm.words import NOT_SPACE, U64, Block, Spans, blocks, int64, mix, per_row, span_hashes, window_hashes, windows

ROUNDS = 3
LEAST_WORDS = 3
FAR = 1 << 40
PART_BYTES = 4 << 20
ASK, KNOWN, TELL = 1, 2, 0
ROWS = "key long, doc long, kind int"
WINDOWS = "h long, g int, doc long"


def symbols(words: Spans, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last level with the words they depend on and their length: ``(name, lo, hi, size)``."""
    n = len(words)
    name, row = words.hash, words.row
    if not n:
        return name, *(np.zeros(0, np.int64),) * 3

    def beside(lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Dependence of the left and of the right neighbour; beyond the row nothing can be relied on."""
        same = row[1:] == row[:-1]
        left_lo, left_hi, right_lo, right_hi = np.full(len(lo), -FAR), hi.copy(), lo.copy(), np.full(len(hi), FAR)
        left_lo[1:][same], left_hi[1:][same] = lo[:-1][same], hi[:-1][same]
        right_lo[:-1][same], right_hi[:-1][same] = lo[1:][same], hi[1:][same]
        return left_lo, left_hi, right_lo, right_hi

    # Runs.
    first = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    name, row = name[start], row[start]
    name = np.where(size > 1, mix(name * U64(0xD6E8FEB86659FD93) + size.astype(U64)), name)
    # A run ends where its neighbours differ, so it depends on one word more on either side.
    edge = np.append(True, row[1:] != row[:-1])
    lo = np.where(edge, -FAR, start - 1)
    hi = np.where(np.append(edge[1:], True), FAR, start + size)
    for level in range(rounds):
        right_side = (mix(name + U64(2 * level + 1)) >> U64(63)).astype(bool)
        pair = ~right_side[:-1] & right_side[1:] & (row[1:] == row[:-1])
        joined, taken = np.append(pair, False), np.append(False, pair)
        left_lo, left_hi, right_lo, right_hi = beside(lo, hi, row)
        # A single symbol depends on the neighbour it could have joined.
        alone = ~joined & ~taken
        near_lo, near_hi = np.where(right_side, left_lo, right_lo), np.where(right_side, left_hi, right_hi)
        lo, hi = np.where(alone, np.minimum(lo, near_lo), lo), np.where(alone, np.maximum(hi, near_hi), hi)
        at = np.flatnonzero(joined)
        name = name.copy()
        name[at] = mix(name[at] * U64(0x9FB21C651E98DF25) + mix(name[at + 1] + U64(level)))
        lo[at], hi[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        size = size.copy()
        size[at] += size[at + 1]
        keep = ~taken
        name, row, lo, hi, size = name[keep], row[keep], lo[keep], hi[keep], size[keep]
    return name, lo, hi, size


def document_keys(words: Spans, n: int) -> np.ndarray:
    """An odd fingerprint of the word sequence of every row (symbols are even)."""
    count = per_row(words.row, n)
    ends = np.cumsum(count)
    return span_hashes(words.hash, ends - count, ends) | U64(1)


def _evidence(words: Spans, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that can show a window to be new: ``(row, name, lo, hi)``; names are even."""
    name, lo, hi, length = symbols(words)
    use = (hi - lo < size) & (length >= LEAST_WORDS)
    lo, hi = lo[use], hi[use]
    return words.row[lo], name[use] & ~U64(1), lo, hi


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a key of a row."""
    return mix(key + mix(row.astype(U64) + U64(1)))


def shared_symbols(texts: DataFrame, size: int) -> DataFrame:
    """``(doc, keys)``: names of a document's symbols that occur elsewhere, and its fingerprint if it is the first with it."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), PART_BYTES):
                words = block.spans(NOT_SPACE)
                doc = batch.column(0).slice(block.first, block.n).to_numpy()
                row, name, _, _ = _evidence(words, size)
                _, first, back, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                often = count > 1
                told = np.flatnonzero(often[back])
                pairs = np.unique(np.stack([doc[row[told]], name[told].view(np.int64)]), axis=1)
                whole = document_keys(words, block.n)
                order = np.lexsort((doc, whole))
                lead = order[np.append(True, whole[order][1:] != whole[order][:-1])]
                keys = np.concatenate([name[first].view(np.int64), pairs[1], whole[lead].view(np.int64)])
                docs = np.concatenate([doc[row[first]], pairs[0], doc[lead]])
                kinds = np.concatenate([np.where(often, KNOWN, ASK), np.full(pairs.shape[1], TELL), np.full(len(lead), ASK)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs), pa.array(kinds.astype(np.int32))], names=["key", "doc", "kind"])

    def answer(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, doc, kind = (table.column(i).to_numpy() for i in range(3))
        told = kind == TELL
        yield pa.RecordBatch.from_arrays([pa.array(doc[told]), pa.array(key[told])], names=["doc", "key"])
        key, doc, kind = key[~told], doc[~told], kind[~told]
        if not len(key):
            return
        order = np.lexsort((doc, key))
        key, doc, kind = key[order], doc[order], kind[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        several = (np.bincount(group) > 1) | (np.maximum.reduceat(kind, start) == KNOWN)
        # Symbols: everybody who asked hears that it is shared. Documents: the first hears so.
        reply = np.where(key & 1 == 1, doc == doc[start][group], several[group] & (kind == ASK))
        yield pa.RecordBatch.from_arrays([pa.array(doc[reply]), pa.array(key[reply])], names=["doc", "key"])

    # Messages are spread by document, so that a frequent symbol's do not meet in one task.
    asked = texts.mapInArrow(run, ROWS).repartition(F.when(F.col("kind") == TELL, F.xxhash64("doc", "key")).otherwise(F.col("key")))
    return asked.mapInArrow(answer, "doc long, key long").groupBy("doc").agg(F.collect_list("key").alias("keys"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of a column of lists, nulls empty."""
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy().view(U64)


def _candidates(block: Block, words: Spans, keys: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that may occur elsewhere as ``(start, fingerprint)``, and which rows are first with their text."""
    of, key = _lists(keys)
    row, name, lo, hi = _evidence(words, size)
    shared = np.isin(_own(row, name), _own(of, key))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.maximum(hi[~shared] - size + 1, 0), 1)
    np.add.at(edge, lo[~shared] + 1, -1)
    at, h = windows(words, size)
    open_ = np.cumsum(edge[:-1])[at] == 0
    first = np.zeros(block.n, bool)
    odd = (key & U64(1)).astype(bool)
    first[of[odd]] = True
    return at[open_], h[open_], first


def repeats(documents: DataFrame, *, size: int = 20, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per document, with ``with_text`` also the text left."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    named = texts.filter("doc is not null")
    told = stored(shared_symbols(named, size), "symbols")
    joined = named.join(told, "doc", "left")

    def ask(batches):
        for batch in batches:
            for block in blocks(batch.column(1), PART_BYTES):
                words = block.spans(NOT_SPACE)
                at, h, first = _candidates(block, words, batch.column(2).slice(block.first, block.n), size)
                use = first[words.row[at]]
                at, h = at[use], h[use]
                doc = batch.column(0).slice(block.first, block.n).to_numpy()[words.row[at]]
                order = np.lexsort((doc, h))
                lead = order[np.append(True, h[order][1:] != h[order][:-1])] if len(h) else order
                second = window_hashes(mix(words.hash + U64(0x632BE59BD9B4E019)), at[lead], size)
                yield pa.RecordBatch.from_arrays([int64(h[lead]), pa.array((second >> U64(33)).astype(np.int32)), pa.array(doc[lead])], names=["h", "g", "doc"])

    firsts = joined.mapInArrow(ask, WINDOWS).groupBy("h", "g").agg(F.min("doc").alias("doc")).groupBy("doc").agg(F.collect_list("h").alias("firsts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")

    def settle(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.spans(NOT_SPACE)
                mine = [batch.column(i).slice(block.first, block.n) for i in range(4)]
                known = mine[0].is_valid().to_numpy(zero_copy_only=False)
                at, h, first = _candidates(block, words, mine[2], size)
                row = words.row[at]
                of, value = _lists(mine[3])
                own = _own(row, h)
                _, lead = np.unique(own, return_index=True)
                keeps = np.zeros(len(at), bool)
                keeps[lead] = True
                keeps &= np.isin(own, _own(of, value))
                edge = np.zeros(len(words) + 1, np.int64)
                gone = at[~keeps & first[row] & known[row]]
                # A later copy of a whole document repeats in every window.
                copies = windows(words, size)[0]
                gone = np.append(gone, copies[(~first & known)[words.row[copies]]])
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + size, -1)
                yield _kept(mine[0], block, words, np.cumsum(edge[:-1]) == 0, with_text)

    out = joined.join(firsts, "doc", "left").unionByName(
        texts.filter("doc is null").select("doc", "text", F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("firsts")))
    return out.select("doc", "text", "keys", "firsts").mapInArrow(settle, schema)


def _kept(doc: pa.Array, block: Block, words: Spans, kept: np.ndarray, with_text: bool) -> pa.RecordBatch:
    """Kept words of every row, joined by one space."""
    starts, ends, row = words.starts[kept], words.ends[kept], words.row[kept]
    edge = np.zeros(len(block.data) + 1, np.int64)
    # The byte after a word is white space if another word of the row follows.
    follow = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends + follow, -1)
    mask = np.cumsum(edge[:-1]) > 0
    data = block.data.copy()
    data[ends[follow]] = 0x20
    total = np.append(0, np.cumsum(mask))[block.offsets]
    raw = data[mask].tobytes()
    parts = [raw[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
    n = per_row(words.row, block.n)
    arrays = [doc, int64(n), int64(n - per_row(row, block.n)), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
    if with_text:
        arrays.append(pa.array([p.decode("utf-8", "replace") for p in parts], pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])
