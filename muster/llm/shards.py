"""Contiguous shards of nearly equal byte size from global prefix sums.

Rows are sorted by document id into range partitions, whose totals give every
partition the bytes and rows before it.  A row's shard is the equal share that
its middle byte falls into, so a shard is off by at most one document at either
end.  Only ids, sizes and checksums are moved; the sorted table is written
once, since the partition numbers in it have to stay facts when tasks are
repeated.  Totals are one row per partition.

Defined results: null text has no bytes (size 8, checksum 0); repeated ids are
ordered by checksum, equal rows are interchangeable; a null id comes first; an
empty table gives no rows; shards stay empty when there are fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from muster.llm.storage import stored

ROW_BYTES = 8


def with_shard(documents: DataFrame, n_shards: int = 24) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row."""
    order = ["doc_id", "text_crc32", "size"]
    text = F.col("text").cast("string")
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"))
    placed = stored(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sized")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per partition of the sorted table.
    offsets = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")])
    total = max(1, totals.agg(F.sum("bytes")).first()[0] or 1)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = placed.join(offsets, "part").select(
        *order, (F.col("rows_before") + F.count(F.lit(1)).over(inside)).alias("row"),
        F.least(F.lit(n_shards - 1), F.floor(
            (start * 2 + F.col("size")).cast("decimal(30,0)") * n_shards / F.lit(2 * total).cast("decimal(30,0)"))).cast("int").alias("shard"))
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))
    # At most n_shards rows.
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
