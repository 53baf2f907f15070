"""Dense row positions without sending all rows through one task.

Rows are bucketed by the high bits of a unique integer key, so a bucket can
hold no more rows than its low bits can tell apart.  Positions are then a rank
inside the bucket plus the number of rows in earlier buckets, and the prefix
sums over buckets are taken level by level in the same way.  Nothing depends on
how rows happen to be partitioned, so a lost executor cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.text import col

# 2^18 rows per bucket, 2^22 buckets per parent, at most 2^24 parents.
KEY_SHIFTS = (18, 40)
# A 60-bit hash is spread evenly: 2^20 buckets need no parent level.
HASH_SHIFTS = (40,)


def _bucket_offsets(counts: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """``counts(bucket, n)`` to ``(bucket, offset)``: rows in earlier buckets."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not steps:
        return counts.select("bucket", before(Window.orderBy("bucket")).alias("offset"))
    parented = counts.withColumn("parent", F.shiftright("bucket", steps[0]))
    parents = parented.groupBy(F.col("parent").alias("bucket")).agg(F.sum("n").alias("n"))
    base = _bucket_offsets(parents, steps[1:]).select(F.col("bucket").alias("parent"), F.col("offset").alias("base"))
    inner = parented.select("bucket", "parent", before(Window.partitionBy("parent").orderBy("bucket")).alias("inner"))
    return inner.join(base, "parent").select("bucket", (F.col("base") + F.col("inner")).alias("offset"))


def with_position(df: DataFrame, key: Column | str = "row_id", out: str = "position",
                  tie: str | None = None, shifts: tuple[int, ...] = KEY_SHIFTS) -> DataFrame:
    """Add the 0-based position of each row in ``key`` order (``tie`` second)."""
    bucketed = df.withColumn("_key", col(key).cast("bigint")).withColumn("_bucket", F.shiftright("_key", shifts[0]))
    counts = bucketed.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    steps = tuple(b - a for a, b in zip(shifts, shifts[1:]))
    offsets = _bucket_offsets(counts, steps).withColumnRenamed("bucket", "_bucket")
    order = ["_key"] if tie is None else ["_key", tie]
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        bucketed.withColumn("_rank", rank).join(offsets, "_bucket")
        .withColumn(out, (F.col("offset") + F.col("_rank")).cast("bigint"))
        .drop("_key", "_bucket", "_rank", "offset")
    )


def shuffle_key(row_id: str = "row_id", seed: int = 42) -> Column:
    """60 bits of a digest of the row id: a fixed pseudo-random order."""
    digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def shuffled(df: DataFrame, row_id: str = "row_id", seed: int = 42, out: str = "position") -> DataFrame:
    """Every row with its place in a seeded shuffle."""
    return with_position(df, shuffle_key(row_id, seed), out, tie=row_id, shifts=HASH_SHIFTS)


def sorted_by(df: DataFrame, **columns: bool) -> DataFrame:
    """Sort by several columns, ascending where true; nulls come last."""
    return df.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in columns.items()])
