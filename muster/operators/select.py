"""Selection, splitting and allocation of contact lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions import text as tx
from muster.functions.classify import lookup
from muster.operators.position import with_position
from muster.operators.skew import lookup_join, top_n
from muster.plans.storage import cut_lineage


def top_per_company(df: DataFrame, company: str, score: str, k: int = 5, row_id: str = "row_id") -> DataFrame:
    """Best ``k`` rows per company by score."""
    return top_n(df, [company], [F.desc(score), F.asc(row_id)], k)


def beyond_top(df: DataFrame, company: str, score: str, k: int = 5, row_id: str = "row_id") -> DataFrame:
    """Rows that ``top_per_company`` leaves out.

    The last row chosen of each company is a bound that its other rows are
    compared with, so no company is ranked as a whole.
    """
    last = top_per_company(df.select(company, score, row_id), company, score, k, row_id).filter(F.col("rank") == k).select(
        company, F.col(score).alias("_score"), F.col(row_id).alias("_id"))
    after = F.expr(f"(`{score}` IS NULL AND _score IS NOT NULL) OR `{score}` < _score OR (`{score}` <=> _score AND `{row_id}` > _id)")
    return lookup_join(df, last, company, row_id, how="inner").filter(after).select(*df.columns)


def top_with_spread(df: DataFrame, company: str, bucket: str, score: str, k: int = 5, row_id: str = "row_id",
                    preferred: list[str] = fv.PREFERRED_SPREAD) -> DataFrame:
    """Best ``k`` per company, first one of each preferred bucket in order.

    Only the best ``k`` rows of a company's bucket can ever be chosen, so the
    first limit is by (company, bucket) and bounds what the second one sees.
    """
    order = [F.desc(score), F.asc(row_id)]
    place = {b: i for i, b in enumerate(preferred)}
    best = top_n(df, [company, bucket], order, k, "_in_bucket")
    turn = F.when(F.col("_in_bucket") == 1, lookup(F.col(bucket), place, len(preferred))).otherwise(len(preferred))
    return top_n(best.withColumn("_turn", turn), [company], [F.asc("_turn"), *order], k).drop("_in_bucket", "_turn")


def bucket_quotas(n_max: int, shares: dict[str, float] = fv.BALANCE_SHARES) -> dict[str, int]:
    """Places per bucket, rounded half-even; the first bucket takes the rest."""
    quotas = {b: round(n_max * s) for b, s in shares.items()}
    first = next(iter(quotas))
    quotas[first] += n_max - sum(quotas.values())
    return quotas


def select_with_quotas(df: DataFrame, company: str, bucket: str, score: str, n_max: int = 200, n_min: int = 150,
                       row_id: str = "row_id", shares: dict[str, float] = fv.BALANCE_SHARES,
                       salts: int = 32) -> DataFrame:
    """Balanced choice of up to ``n_max`` rows per company.

    Companies with at most ``n_min`` rows are kept whole; others give each
    bucket its quota by score and fill up with the best rows left.  Ranking by
    (company, bucket) keeps one row more than any choice can need, so every
    later step works on groups of bounded size and the size test stays exact.
    """
    quotas = bucket_quotas(n_max, shares)
    order = [F.desc(score), F.asc(row_id)]
    # Padded spellings are one company.
    df, given, company = df.withColumn("_company", tx.strip(company)), df.columns, "_company"
    keep = max(n_max, n_min) + 1
    best = top_n(df, [company, bucket], order, keep, "_in_bucket", salts)
    whole = F.count(F.lit(1)).over(Window.partitionBy(company)) <= n_min
    picked = F.col("_in_bucket") <= lookup(F.col(bucket), quotas, 0)
    turn = F.when(picked, lookup(F.col(bucket), {b: i for i, b in enumerate(quotas)}, len(quotas))).otherwise(len(quotas))
    ranked = best.withColumn("_whole", whole).withColumn("_turn", turn).withColumn(
        "rank", F.row_number().over(Window.partitionBy(company).orderBy("_turn", *order))
    )
    return ranked.filter(F.col("_whole") | (F.col("rank") <= n_max)).select(*given, "rank")


def cycled_names(names: list[str], slots: int) -> list[str]:
    """Names for every slot: repeated in turn, or cut to length."""
    clean = [n.strip() for n in names if n.strip()] or ["Unassigned"]
    return [clean[i % len(clean)] for i in range(slots)]


def split_even(df: DataFrame, parts: int, row_id: str = "row_id", out: str = "part",
               position: str = "position") -> DataFrame:
    """Contiguous parts whose sizes differ by at most one, larger parts first."""
    placed = df if position in df.columns else with_position(df, row_id, position)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return placed.withColumn("_n", total).withColumn(out, _part_of(F.col(position), F.col("_n"), parts)).drop("_n")


def _part_of(p: Column, n: Column, parts: int) -> Column:
    small, extra = F.floor(n / parts), n % parts
    head = extra * (small + 1)
    later = extra + F.floor((p - head) / F.greatest(small, F.lit(1)))
    return F.when(p < head, F.floor(p / (small + 1))).otherwise(later).cast("int")


def owners_of(df: DataFrame, connections: DataFrame, url: str = "url", row_id: str = "row_id") -> DataFrame:
    """Add ``owner``: the first member whose connections hold the row's URL."""
    first = (
        connections.select(tx.profile_url("url").alias("_url"), "member_idx")
        .filter(F.contains("_url", F.lit("linkedin.com/")))
        .groupBy("_url").agg(F.min("member_idx").alias("owner"))
    )
    return lookup_join(df.withColumn("_url", tx.profile_url(url)), first, "_url", row_id).drop("_url")


def allocate(df: DataFrame, members: int, owner: str = "owner", row_id: str = "row_id", out: str = "member_idx") -> DataFrame:
    """Owned rows stay with their owner; the rest even out the members.

    Giving each remaining row to the member with most room (lowest index on
    ties) hands out slots level by level: a member with room ``h`` takes part in
    levels ``h`` down to 1.  Between two neighbouring values of ``h`` the same
    members take turns, so a row's member follows from its position by integer
    arithmetic on at most ``members`` runs of levels.

    Rows with their owners are stored once: counts, positions and the result
    all read that table, so owners are looked up a single time.
    """
    df = cut_lineage(df)
    owned = df.filter(F.col(owner).isNotNull()).withColumn(out, F.col(owner).cast("int"))
    rest = with_position(df.filter(F.col(owner).isNull()), row_id, "_k")
    runs = allocation_runs(df, members, owner).scalar()
    placed = rest.withColumn("_runs", runs).withColumn(
        "_run", F.element_at(F.filter("_runs", lambda r: r["start"] <= F.col("_k")), -1)
    )
    turn = F.pmod(F.col("_k") - F.col("_run.start"), F.size("_run.members")).cast("int")
    return owned.unionByName(
        placed.withColumn(out, F.get(F.col("_run.members"), turn)).drop("_k", "_runs", "_run")
    )


def allocation_runs(df: DataFrame, members: int, owner: str = "owner") -> DataFrame:
    """One row, one array: ``struct(start, members)`` per run of equal turns."""
    counts = df.groupBy(F.col(owner).cast("int").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("m", "n")))).alias("held"),
    )
    # Room of a member: its even share less what it already holds.
    share = lambda i: F.floor(F.col("total") / members) + F.when(i < F.col("total") % members, 1).otherwise(0)
    room = F.transform(
        F.sequence(F.lit(0), F.lit(members - 1)),
        lambda i: F.struct(i.alias("m"), (share(i) - F.coalesce(F.col("held")[i], F.lit(0))).cast("bigint").alias("h")),
    )
    active = totals.select(F.filter(room, lambda r: r["h"] > 0).alias("room"))
    levels = F.reverse(F.array_sort(F.array_distinct(F.transform("room", lambda r: r["h"]))))
    runs = active.select("room", levels.alias("levels")).select(
        F.transform(
            "levels",
            lambda h, i: F.struct(
                F.transform(F.filter("room", lambda r: r["h"] >= h), lambda r: r["m"]).alias("members"),
                (h - F.coalesce(F.get(F.col("levels"), i + 1), F.lit(0))).alias("depth"),
            ),
        ).alias("runs")
    )
    start = lambda i: F.aggregate(
        F.slice("runs", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, r: a + r["depth"] * F.size(r["members"])
    )
    return runs.select(
        F.transform("runs", lambda r, i: F.struct(start(i).alias("start"), r["members"].alias("members"))).alias("runs")
    )


def part_ranges(parts: DataFrame, part: str = "part", rows: str = "rows") -> DataFrame:
    """``start - end`` row ranges of consecutive parts; one row per part."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(rows).over(w)
    return parts.withColumn("row_range", F.concat((end - F.col(rows) + 1).cast("string"), F.lit(" - "), end.cast("string")))
