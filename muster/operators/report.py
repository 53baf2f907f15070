"""Counts, rates and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions import text as tx
from muster.functions.classify import messages, segment_rank
from muster.plans.storage import cut_lineage


def roll_up_small(df: DataFrame, group: str, groups: list[str], min_rows: int = 10,
                  fallback: str = fv.DEFAULT_BUCKET) -> DataFrame:
    """Rows of groups smaller than ``min_rows`` move to ``fallback``.

    ``groups`` is the closed list of group labels, so the counts fit one small
    map that enters the plan as a scalar; the rows themselves are not shuffled.
    """
    sizes = (
        df.filter(F.col(group).isin(*groups)).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct(group, "n"))).alias("sizes"))
    )
    kept = F.coalesce(F.col("_sizes")[F.col(group)], F.lit(0)) >= min_rows
    return (
        df.withColumn("_sizes", sizes.scalar())
        .withColumn(group, F.when(kept | (F.col(group) == fallback), F.col(group)).otherwise(fallback))
        .drop("_sizes")
    )


def group_rate(df: DataFrame, group: str, counted: str, flag: str) -> DataFrame:
    """Per group: non-null ``counted``, rows with ``flag`` and their rate, largest first."""
    total, hits = F.count(counted), F.count_if(flag)
    return df.groupBy(group).agg(
        total.alias("total"), hits.alias("influencers"), tx.rate(hits, total, 3).alias("influencer_rate")
    ).orderBy(F.desc("total"), group)


def segment_counts(df: DataFrame, org: str = "org_type", segment: str = "segment") -> DataFrame:
    """Rows per organisation type and segment, in business order."""
    counts = df.groupBy(org, segment).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", segment_rank(F.col(org), F.col(segment))).orderBy(org, "rank")


def dense_grid(df: DataFrame, state: str, kind: str, focus: str, states: list[str],
               kinds: list[str] = fv.COMPANY_TYPES, focuses: list[str] = fv.FOCUS_LABELS,
               anywhere: str | None = fv.MESSAGE_ANYWHERE) -> DataFrame:
    """A row for every combination, empty ones included, with its messages."""
    spark = df.sparkSession
    cells = [(s, k, f) for s in states for k in kinds for f in focuses]
    grid = values(spark, cells, "state", "kind", "focus")
    counts = df.groupBy(F.col(state).alias("state"), F.col(kind).alias("kind"), F.col(focus).alias("focus")).agg(
        F.count(F.lit(1)).alias("n")
    )
    texts = messages(F.col("state"), F.col("kind"), F.col("focus"), anywhere)
    return grid.join(counts, ["state", "kind", "focus"], "left").select(
        F.concat_ws(" - ", "state", "kind", "focus").alias("segment"),
        F.coalesce("n", F.lit(0)).alias("count"),
        *[c.alias(n) for n, c in texts.items()],
    )


def values(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small literal table, planned as a local relation."""
    quote = lambda v: "CAST(NULL AS STRING)" if v is None else (
        str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    )
    body = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(f'`{n}`' for n in names)})")


def distinct_by_id(df: DataFrame, group: str, ids: list[str], fallback: list[str] = ()) -> DataFrame:
    """Distinct people per group, by the first id column that holds any value.

    Without one, people are told apart by the ``fallback`` columns together.
    """
    filled = [F.when(F.count(c) > 0, F.lit(i)) for i, c in enumerate(ids)]
    chosen = df.agg(F.coalesce(*filled, F.lit(-1)).alias("i")).scalar()
    person = F.concat_ws("|", *[tx.text(c) for c in fallback]) if fallback else F.lit(None).cast("string")
    picked = reduce(lambda acc, i: F.when(F.col("_id") == i, F.col(ids[i]).cast("string")).otherwise(acc),
                    reversed(range(len(ids))), person)
    return df.withColumn("_id", chosen).groupBy(group).agg(F.countDistinct(picked).alias("contacts"))


def variants(df: DataFrame, key: str, name: str, row_id: str = "row_id", preview: int = 6) -> DataFrame:
    """Per key: first name as display, number of names and a short preview.

    Only the first few names of a key are gathered; a limit that runs before
    the shuffle keeps a key with very many names from reaching one task.
    """
    from muster.operators.skew import top_n

    first = top_n(df.select(key, name, row_id), [key], [F.asc(row_id)], preview, "_nth")
    shown = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(row_id, name))).alias("_first"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("variants"))
    text = F.array_join(F.transform("_first", lambda r: r[name]), ", ")
    return sizes.join(shown, key).select(
        key, F.get("_first", F.lit(0))[name].alias("display"), "variants",
        F.concat(text, F.when(F.col("variants") > preview, " ...").otherwise("")).alias("preview"),
    )


def heavy_buckets(named: DataFrame, n: int) -> DataFrame:
    """The ``bucket`` numbers that can hold one of the ``n`` most frequent ``value``.

    ``named`` holds ``value`` and ``bucket``, a function of the value.  The rows
    of a bucket bound the count of each of its values, and such sums merge, so
    they are all that moves.  Values in the ``n`` fullest buckets are counted
    exactly: the ``n``-th largest of these counts (0 if there are fewer) is one
    that every value sought must reach, and so must its bucket.
    """
    sums = cut_lineage(named.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")))
    fullest = sums.orderBy(F.desc("rows"), "bucket").limit(n).select("bucket")
    counts = named.join(F.broadcast(fullest), "bucket", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    least = counts.orderBy(F.desc("n")).limit(n).agg(F.when(F.count(F.lit(1)) == n, F.min("n")).otherwise(0).alias("n"))
    return sums.filter(F.col("rows") >= least.scalar()).select("bucket")


def top_values(df: DataFrame, column: str, n: int = 20, blank: str = "(blank)", buckets: int = 1 << 16) -> DataFrame:
    """Most frequent values, counted exactly; null shows as ``blank``.

    A first pass sums rows per hash bucket, and only values of buckets full
    enough to matter are grouped, so the shuffles carry bucket sums and few
    values instead of every distinct one.  The column is read three times.  If
    all values are about as frequent, no bucket can be ruled out and the last
    pass is the plain count.  At most ``buckets`` numbers are broadcast.
    """
    value = F.coalesce(F.col(column), F.lit(blank)).alias("value")
    named = df.select(value).withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    found = named.join(F.broadcast(heavy_buckets(named, n)), "bucket", "left_semi")
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("cols"))
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dedupe_report(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Rows before, after and removed by keeping one row per key."""
    sizes = df.groupBy(*[tx.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count(F.lit(1)).alias("after"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("removed"),
    )


def column_ratio(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Share of rows whose value contains a text, per column, in one pass."""
    names = columns or df.columns
    share = lambda c: F.avg(F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle)), F.lit(False)).cast("int"))
    one = df.agg(*[share(c).alias(f"_{i}") for i, c in enumerate(names)])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"_{i}").alias("share")) for i, c in enumerate(names)
    ])
    return one.select(F.inline(pairs))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(F.lower(column), column)
