"""Document lengths from flat token streams that carry no index.

``write_streams`` lays the ids of whole documents end to end, a separator after
each, and cuts the stream into blocks of a fixed number of ids wherever that
falls.  ``count_tokens`` finds the separators of a block with one vectorised
comparison; a document that crosses blocks is put together by a prefix scan
over the blocks (ids before a block, and the place of the last separator before
it), done in two levels so that no task sees more than ``GROUP`` blocks or one
row per group of a stream.

Defined results: null and empty texts have no tokens; ids after the last
separator of a stream are an unfinished document (``complete`` false, no
``doc_id``); a stream without separators is one; an empty table gives no rows;
repeated documents are counted one by one; a text that itself encodes to the
separator's id has ``STAND_IN`` in those places, so that in a stream the
separator only ever ends a document, and such an id counts as a token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from muster.llm.storage import stored
from muster.llm.tokenize import encoder
from muster.llm.words import blocks

#: Ids of a block: 16 KB, so that a reader's batch of rows stays in bounds.
BLOCK_IDS = 1 << 12
GROUP = 4096
#: Blocks handed on or looked at together.
ROWS = 256
#: Stands for the separator's id inside a text; no vocabulary has so large an id.
STAND_IN = (1 << 32) - 1
STREAM = "stream long, block long, ids binary, doc_ids array<long>"
SCAN = "stream long, block long, n long, first long, last long, lengths array<long>, doc_ids array<long>"


def write_streams(documents: DataFrame, vocabulary: str, separator: int, *, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One stream per partition as little-endian unsigned 32-bit ids, written to the shared folder.

    ``doc_ids`` names the documents that end in a block; it says nothing of
    where they end.
    """

    if separator == STAND_IN:
        raise ValueError("this id stands for the separator inside texts")

    def run(batches):
        encode, stream, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        pending, names, held = [], [], 0

        def flush(size: int):
            nonlocal pending, names, held, number
            line = np.concatenate(pending) if pending else np.zeros(0, "<u4")
            ends = iter(names)
            whole = len(line) // size * size if len(line) else 0
            for lo in range(0, whole, size * ROWS):
                out = []
                for at in range(lo, min(lo + size * ROWS, whole), size):
                    part = line[at:at + size]
                    out.append((stream, number, part.tobytes(), [next(ends) for _ in range(int((part == separator).sum()))]))
                    number += 1
                yield batch_of(out)
            line = line[whole:].copy()
            pending, names, held = [line], list(ends), len(line)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))],
                                              names=["stream", "block", "ids", "doc_ids"])

        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, counts = encode.encode(block)
                ids = np.where(ids == separator, np.uint32(STAND_IN), ids)
                pending.append(np.insert(ids, np.cumsum(counts), separator).astype("<u4"))
                names += batch.column(0).slice(block.first, block.n).to_pylist()
                held += len(pending[-1])
                if held >= block_ids:
                    yield from flush(block_ids)
        # What is left is the last, shorter block; later steps need no table of pieces.
        if held:
            yield from flush(held)
        encode.clear()

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(texts.mapInArrow(run, STREAM), "streams")


def scan_blocks(streams: DataFrame, separator: int) -> DataFrame:
    """Per block: ids, first and last separator, lengths of the documents that end in it counted from the block's start."""

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield batch.slice(at, ROWS)

    def run(batches):
        for batch in parts(batches):
            columns = {c: [] for c in ("n", "first", "last", "lengths")}
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), "<u4") if raw.is_valid else np.zeros(0, "<u4")
                at = np.flatnonzero(ids == separator)
                columns["n"].append(len(ids))
                columns["first"].append(int(at[0]) if len(at) else None)
                columns["last"].append(int(at[-1]) if len(at) else None)
                columns["lengths"].append((np.diff(at, prepend=-1) - 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(columns[c], pa.int64()) for c in ("n", "first", "last")],
                 pa.array(columns["lengths"], pa.list_(pa.int64())), batch.column(3)], names=[f.split()[0] for f in SCAN.split(", ")])

    return streams.select("stream", "block", "ids", "doc_ids").mapInArrow(run, SCAN)


def count_tokens(streams: DataFrame, separator: int) -> DataFrame:
    """``(doc_id, n_tokens, complete)`` per document; separators are not counted."""
    scanned = stored(scan_blocks(streams, separator), "scan").withColumn("_group", F.expr(f"block div {GROUP}"))
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    near, far = earlier("stream", "_group", by="block"), earlier("stream", by="_group")
    local = scanned.withColumn("_start", F.coalesce(F.sum("n").over(near), F.lit(0)))
    groups = local.groupBy("stream", "_group").agg(F.sum("n").alias("_n"), F.max(F.col("_start") + F.col("last")).alias("_last"))
    base = groups.withColumn("_base", F.coalesce(F.sum("_n").over(far), F.lit(0))).withColumn(
        "_before", F.max(F.col("_base") + F.col("_last")).over(far)).select("stream", "_group", "_n", "_base", "_before", "_last")
    placed = local.join(base.select("stream", "_group", "_base", "_before"), ["stream", "_group"]).withColumn("_at", F.col("_base") + F.col("_start"))
    last = F.coalesce(F.max(F.col("_at") + F.col("last")).over(near), F.col("_before"), F.lit(-1))
    # Ids since the last separator, at the start of the block.
    carried = placed.withColumn("_carry", F.col("_at") - last - 1)
    ended = carried.filter("first is not null").select("_carry", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("_k", "_doc"))
    whole = ended.select(F.col("_doc.doc_ids").alias("doc_id"), (F.col("_doc.lengths") + F.when(F.col("_k") == 0, F.col("_carry")).otherwise(0)).alias("n_tokens"),
                         F.lit(True).alias("complete"))
    tails = base.groupBy("stream").agg(F.max(F.col("_base") + F.col("_n")).alias("_end"), F.max(F.col("_base") + F.col("_last")).alias("_final"))
    rest = tails.select((F.col("_end") - F.coalesce("_final", F.lit(-1)) - 1).alias("n_tokens")).filter("n_tokens > 0")
    return whole.unionByName(rest.select(F.lit(None).cast("long").alias("doc_id"), "n_tokens", F.lit(False).alias("complete")))
