"""Joins and rankings that stay parallel when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares per shuffle partition: a task's own keys and its shares then average out.
SHARES_PER_PARTITION = 8
#: Rows of the left side that a cell of ``pair_join`` holds at most, and rows of its right side that are gathered in one row, about.
CELL_ROWS, GATHERED = 1 << 16, 1 << 12
#: Rows of a block of ``pair_join``.  Parquet packs values in groups of 8 and runs of up to 504, so a block of 56 that is written
#: again and again repeats itself byte by byte.  Larger blocks save few bytes more, and the rows a block makes leave the CPU's cache.
BLOCK_ROWS = 56


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of all non-null keys."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def share_count(df: DataFrame) -> int:
    """Number of equal shares that all rows are thought of as cut into."""
    return SHARES_PER_PARTITION * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_shares(counts: DataFrame, key: str, parts: int, count: str = "n") -> DataFrame:
    """``(key, _shares)`` of every key with more than one part in ``parts`` of all counted rows.

    A key gets as many shares as it has such parts, so a share never holds more
    than ``1 / parts`` of the rows, however many keys are frequent.  At most
    ``parts`` keys can pass the filter and their shares add up to at most
    ``2 * parts``: that bounds both the list and the copies made of the other
    side.  The list only routes rows; results never depend on it.
    """
    total = counts.agg(F.sum(count)).scalar()
    filled = F.col(count).cast("double") * parts / total
    return counts.filter(filled > 1).select(key, F.ceil(filled).cast("int").alias("_shares"))


def lookup_join(df: DataFrame, table: DataFrame, key: str, row_id: str = "row_id", how: str = "left",
                counts: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Join a large table to a keyed one, cutting frequent keys into shares in proportion to their rows.

    Rows of a frequent key go to one of its shares by the hash of ``row_id``;
    the few matching rows of ``table`` are repeated once per share.  Callers
    that already counted the keys pass ``counts(key, n)``.
    """
    counts = key_counts(df, key) if counts is None else counts
    # At most ``parts`` keys by construction, which is what makes broadcasting them safe.
    hot = F.broadcast(key_shares(counts, key, parts or share_count(df)))
    left = df.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_shares").isNotNull(), F.pmod(F.xxhash64(row_id), F.col("_shares")).cast("int"))
        # Null matches nothing, so its rows may go anywhere.
        .when(F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(1 << 30)).cast("int")).otherwise(0)
    ).drop("_shares")
    copies = F.when(F.col("_shares").isNotNull(), F.sequence(F.lit(0), F.col("_shares") - 1)).otherwise(F.array(F.lit(0)))
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_shares")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def pair_grid(counts: DataFrame, key: str, parts: int) -> DataFrame:
    """``(key, _across, _down, _slots)`` of every key of ``counts(key, n, m)`` whose ``n`` times ``m`` pairs need more than one cell.

    A key's ``n`` rows are cut ``_across`` times and its ``m`` rows ``_down``
    times, so that a cell holds about one part in ``parts`` of all pairs.  Cells
    are as nearly square as that allows: copies then grow with the square root of
    the number of cells.  No cell has more than about ``CELL_ROWS`` of the ``n``
    rows.  ``_slots`` is a multiple of ``_down`` that leaves about ``GATHERED`` of the ``m`` rows each.

    At most ``parts`` keys pass for their pairs and one per ``CELL_ROWS`` or
    ``GATHERED`` rows for its rows, which bounds the list.  It only routes rows.
    """
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    cells = n * m * parts / counts.agg(F.sum(n * m)).scalar()
    across = F.ceil(F.greatest(F.least(F.sqrt(cells * n / m), n), n / CELL_ROWS, F.lit(1.0))).cast("int")
    sides = counts.withColumn("_across", across).withColumn("_down", F.ceil(F.greatest(F.least(cells / F.col("_across"), m), F.lit(1.0))).cast("int"))
    slots = F.col("_down") * F.ceil(m / (F.col("_down") * F.lit(float(GATHERED)))).cast("int")
    return sides.select(key, "_across", "_down", slots.alias("_slots")).filter("_across * _slots > 1")


def pair_join(df: DataFrame, table: DataFrame, key: str, counts: DataFrame, number: str, parts: int | None = None) -> DataFrame:
    """Inner join of two tables of which either may hold many rows of a key, so that the result is far longer than both.

    ``counts(key, n, m)`` has the rows of each side per key; ``number`` is a
    stored column of both that tells rows apart, as far as they should go to
    different cells.  The pairs of a key are dealt to the cells of a grid (see
    ``pair_grid``), so neither side is copied to every share of the other.

    Rows of ``table`` meet those of ``df`` in blocks, and a block goes by once per row
    of ``df``: its rows then follow each other in the same order again and again, while
    the row of ``df`` stands still.  Column files hold such rows in a small
    part of the bytes that they take in other orders.

    The number of partitions is fixed because a task's work is the rows it makes, which the bytes it reads do not show.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(pair_grid(counts, key, parts or share_count(df)))
    dealt = lambda ways: F.pmod(F.xxhash64(number), F.col(ways)).cast("int")
    cells = lambda found: F.explode(F.when(F.col("_slots").isNotNull(), found).otherwise(F.array(F.lit(0))))
    kept = [c for c in df.columns if c not in (key, number)]
    first = dealt("_across") * F.col("_down")
    left = df.join(hot, key, "left").select(key, cells(F.sequence(first, first + F.col("_down") - 1)).alias("_salt"), *kept)
    cols = F.struct(*[c for c in table.columns if c not in (key, number)])
    slot = F.coalesce(dealt("_slots"), F.lit(0)).alias("_slot")
    gathered = table.join(hot, key, "left").groupBy(key, "_across", "_down", "_slots", slot).agg(F.collect_list(cols).alias("_rows"))
    block = F.transform(F.sequence(F.lit(1), F.size("_rows"), F.lit(BLOCK_ROWS)), lambda i: F.slice("_rows", i, BLOCK_ROWS))
    blocks = gathered.withColumn("_block", F.explode(block)).select(
        key, cells(F.transform(F.sequence(F.lit(0), F.col("_across") - 1), lambda i: i * F.col("_down") + F.col("_slot") % F.col("_down"))).alias("_salt"), "_block")
    on = [key, "_salt"]
    # A merge join reads its left side once and goes over the right side's rows of a cell for each row of the left.
    met = blocks.repartition(n, *on).hint("merge").join(left.repartition(n, *on), on)
    return met.select(key, *kept, F.inline("_block"))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the shuffle partitions.

    Few bytes are read by few tasks, however much work each of their rows is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_n(df: DataFrame, keys: list[Column | str], order: list[Column], n: int, rank: str = "rank",
          salts: int = 0) -> DataFrame:
    """First ``n`` rows of every group, with their rank.

    The rank filter runs as a group limit before the shuffle, so a task sends at
    most ``n`` rows per group.  With ``salts`` a middle step merges those of
    several tasks, so that a hot group's final task sees ``n * salts`` rows
    however many tasks read it.
    """
    if salts:
        # The salt only routes rows, so any stable per-task value will do.
        df = df.withColumn("_salt", F.spark_partition_id() % salts)
        first = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = df.withColumn(rank, first).filter(F.col(rank) <= n).drop(rank, "_salt")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= n)
