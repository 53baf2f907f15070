"""Header normalisation, column mapping, projection and validation.

Mapping works on a header catalogue, ``(file_id, pos, header)``, so that the
columns of thousands of files are matched in one job.  Matching is done once
per distinct header text; files then only pick among their own headers.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster import fixed_values as fv
from muster.functions import similarity as sim
from muster.functions import text as tx
from muster.operators.report import values


# ------------------------------------------------------------------- headers

def trimmed(c) -> Column:
    return tx.strip(c)


def squashed(c) -> Column:
    """Single spaces, lower case."""
    return tx.space_lower(c)


def snake(c) -> Column:
    """Letters, digits and single underscores."""
    s = F.regexp_replace(F.lower(tx.strip(tx.text(c))), r"[\s\-]+", "_")
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "[^0-9a-z_]", ""), "_+", "_"), F.lit("_"))


def rename_all(df: DataFrame, rule) -> DataFrame:
    """Rename every column by a Python function of its name."""
    return df.toDF(*[rule(c) for c in df.columns])


# ------------------------------------------------------------------- mapping

def _first_per_file(found: DataFrame, rank: Column) -> DataFrame:
    """``(file_id, target, source)``: the header with the lowest rank."""
    return found.groupBy("file_id", "target").agg(F.min_by("header", rank).alias("source"))


def map_exact(headers: DataFrame, targets: list[str]) -> DataFrame:
    """Same name ignoring case, else the same after Unicode and space cleaning."""
    spark = headers.sparkSession
    clean = lambda s: " ".join(unicodedata.normalize("NFKD", s).split()).lower()
    wanted = values(spark, [(t, t.lower(), clean(t)) for t in targets], "target", "low", "clean")
    texts = headers.select("header").distinct()
    texts = texts.select("header", F.lower("header").alias("low"), tx.nfkd_lower("header").alias("clean"))
    same = texts.join(wanted.drop("clean"), "low").select("header", "target", F.lit(0).alias("level"))
    close = texts.join(wanted.drop("low"), "clean").select("header", "target", F.lit(1).alias("level"))
    found = headers.join(same.unionByName(close), "header")
    # Of equal names the last column counts, of similar ones the first.
    order = F.struct("level", F.when(F.col("level") == 0, -F.col("pos")).otherwise(F.col("pos")))
    return _first_per_file(found, order)


def map_alias(headers: DataFrame, aliases: dict[str, list[str]] = fv.OUTREACH_ALIASES, targets: list[str] = fv.OUTREACH_COLUMNS,
              direct: bool = True) -> DataFrame:
    """First alias present in the file; with ``direct`` the name itself comes first."""
    rows = []
    for t in targets:
        key = " ".join(t.split()).lower()
        names = ([key] if direct or key not in aliases else []) + aliases.get(key, [])
        rows += [(t, " ".join(n.split()).lower(), i) for i, n in enumerate(names)]
    wanted = values(headers.sparkSession, rows, "target", "norm", "rank")
    found = headers.withColumn("norm", squashed("header")).join(wanted, "norm")
    return _first_per_file(found, F.struct("rank", -F.col("pos")))


def _offers(headers: DataFrame, targets: dict[str, list[str]], normalise) -> DataFrame:
    """Every distinct header beside each of a fixed number of target names."""
    entries = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(n).alias("name"), F.lit(i).alias("nth")) for t, ns in targets.items() for i, n in enumerate(ns)
    ])
    texts = headers.select("header").distinct().withColumn("norm", normalise("header"))
    return texts.select("header", "norm", F.inline(entries))


def map_similarity(headers: DataFrame, targets: list[str] = fv.SCRAPED_COLUMNS, aliases: dict[str, list[str]] = fv.SCRAPED_ALIASES,
                   cut: float = 0.72) -> DataFrame:
    """Most similar header by edit ratio over a target's name and aliases.

    An alias match scores 1; headers are tried in sorted order, the first of
    equal scores wins.
    """
    def norm(s: str) -> str:
        s = re.sub(r"[\s\-]+", "_", s.strip().lower())
        return re.sub("_+", "_", re.sub("[^0-9a-z_]", "", s)).strip("_")

    names = {t: [norm(a) for a in [t] + aliases.get(t, [])] for t in targets}
    offers = _offers(headers, names, snake)
    near = offers.filter(sim.length_compatible(F.col("norm"), F.col("name"), cut * 100))
    scored = near.select("header", "target", sim.lev_ratio("norm", "name").alias("score"))
    best = scored.groupBy("header", "target").agg(F.max("score").alias("score")).filter(F.col("score") >= cut)
    found = headers.select("file_id", "header").distinct().join(best, "header")
    return _first_per_file(found, F.struct(-F.col("score"), F.col("header")))


def map_similarity_bonus(headers: DataFrame, targets: list[str] = fv.SELECTION_COLUMNS, cut: float = 0.45) -> DataFrame:
    """Most similar header by edit ratio, raised a little by a matching word."""
    offers = _offers(headers, {t: [t.lower()] for t in targets}, F.lower)
    extra = F.lit(0.0)
    low = F.lower("header")
    for group, word in [(["linkedInProfileUrl", "ProfileUrl"], "profile"), (["companyName"], "company")]:
        extra = extra + F.when(F.col("target").isin(group) & F.contains(low, F.lit(word)), 0.05).otherwise(0.0)
    for t in ["firstName", "lastName", "fullName", "title", "location", "industry"]:
        word = t.replace("Name", "").lower()
        extra = extra + F.when((F.col("target") == t) & F.contains(low, F.lit(word)), 0.05).otherwise(0.0)
    # A bonus lifts a score by 0.05 at most; shorter reach cannot pass the cut.
    near = offers.filter(sim.length_compatible(F.col("norm"), F.col("name"), (cut - 0.05) * 100))
    scored = near.select("header", "target", (sim.lev_ratio("norm", "name") + extra).alias("score"))
    best = scored.groupBy("header", "target").agg(F.max("score").alias("score")).filter(F.col("score") >= cut)
    return _first_per_file(headers.join(best, "header"), F.struct(-F.col("score"), F.col("pos")))


def map_similarity_alias(headers: DataFrame, targets: list[str] = fv.SEGMENTED_COLUMNS, aliases: dict[str, list[str]] = fv.SEGMENTED_ALIASES,
                         cut: float = 85) -> DataFrame:
    """Same name, else a header closer to the target than any alias, else token order."""
    low = lambda s: " ".join(s.split()).lower()
    offers = _offers(headers, {t: [low(t)] for t in targets}, squashed)
    # How close the best alias comes is known before any data is read.
    limits = {t: max(_ratio_text(low(t), a) for a in aliases[t]) for t in targets if t in aliases}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("target")]
    scored = offers.select(
        "header", "target", (F.col("norm") == F.col("name")).alias("same"),
        F.when(limit.isNotNull(), sim.ratio("norm", "name")).alias("r"), sim.token_sort_ratio("norm", "name").alias("s"), limit.alias("limit"),
    ).groupBy("header", "target").agg(
        F.max("same").alias("same"), F.max("r").alias("r"), F.max("s").alias("s"), F.max("limit").alias("limit")
    )
    usable = scored.filter(F.col("same") | (F.col("r") >= F.col("limit")) | (F.col("s") >= cut))
    level = F.when(F.col("same"), 0).when(F.col("r") >= F.col("limit"), 1).otherwise(2)
    score = F.when(level == 0, F.lit(0.0)).when(level == 1, -F.col("r")).otherwise(-F.col("s"))
    return _first_per_file(headers.join(usable, "header"), F.struct(level, score, F.col("pos")))


def _ratio_text(a: str, b: str) -> float:
    """Indel ratio of two constants, for settling alias limits at plan time."""
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    total = len(a) + len(b)
    return 100.0 if total == 0 else (1.0 - (total - 2 * row[-1]) / total) * 100.0


def map_similarity_loose(headers: DataFrame, targets: list[str] = fv.STATE_SPLIT_COLUMNS, cut: float = 50) -> DataFrame:
    """Same name ignoring case, else the best token order score."""
    offers = _offers(headers, {t: [t] for t in targets}, lambda c: F.col(c))
    scored = offers.select(
        "header", "target", (F.lower("header") == F.lower("name")).alias("same"), sim.token_sort_ratio("norm", "name").alias("s")
    ).groupBy("header", "target").agg(F.max("same").alias("same"), F.max("s").alias("s"))
    usable = scored.filter(F.col("same") | (F.col("s") >= cut))
    score = F.when(F.col("same"), F.lit(-1000.0)).otherwise(-F.col("s"))
    return _first_per_file(headers.join(usable, "header"), F.struct(score, F.col("pos")))


def map_substring(headers: DataFrame, patterns: dict[str, list[str]] = fv.SUBSTRING_HEADERS) -> DataFrame:
    """First header containing a pattern, patterns in order; else the first header."""
    low = F.lower("header")
    rank = lambda ps: F.coalesce(
        reduce(lambda acc, ip: F.when(F.contains(low, F.lit(ip[1])), ip[0]).otherwise(acc), reversed(list(enumerate(ps))), F.lit(None)), F.lit(len(ps))
    )
    picks = [F.min_by("header", F.struct(rank(ps), F.col("pos"))).alias(t) for t, ps in patterns.items()]
    wide = headers.groupBy("file_id").agg(*picks)
    return wide.unpivot(["file_id"], list(patterns), "target", "source")


def load_mapping(saved: DataFrame, headers: DataFrame, text: str = "mapping") -> DataFrame:
    """Entries of saved JSON mappings whose source column exists in the file."""
    entries = saved.select("file_id", F.explode(F.from_json(text, "map<string,string>")).alias("target", "source"))
    present = headers.select("file_id", F.col("header").alias("source")).distinct()
    return entries.filter("source IS NOT NULL").join(present, ["file_id", "source"], "left_semi").select("file_id", "target", "source")


def mapping_json(mapping: DataFrame) -> DataFrame:
    """One JSON object per file, targets in order; a file has a fixed set of targets."""
    entries = F.array_sort(F.collect_list(F.struct("target", "source")))
    return mapping.groupBy("file_id").agg(F.to_json(F.map_from_entries(entries)).alias("mapping"))


def missing_columns(headers: DataFrame, required: list[str], ignore_case: bool = True) -> DataFrame:
    """``(file_id, missing)``: required headers a file does not have."""
    name = F.lower(tx.strip("header")) if ignore_case else tx.strip("header")
    wanted = F.array(*[F.struct(F.lit(r).alias("missing"), F.lit(r.lower() if ignore_case else r).alias("name")) for r in required])
    # Which of the few required names a file has fits one row per file.
    has = [F.max(name == (r.lower() if ignore_case else r)).alias(f"_{i}") for i, r in enumerate(required)]
    found = headers.groupBy("file_id").agg(*has)
    present = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(r)) for i, r in enumerate(required)]))
    return found.select("file_id", F.explode(F.filter(wanted, lambda w: ~F.array_contains(present, w["missing"]))).alias("w")).select(
        "file_id", F.col("w.missing").alias("missing")
    )


def url_column(df: DataFrame, needle: str = "linkedin.com/", share: float = 0.3) -> DataFrame:
    """Name of the profile URL column: by header, else by content in one pass."""
    from muster.operators.report import column_ratio

    low = {c: " ".join(c.split()).lower() for c in df.columns}
    named = [c for c in df.columns if c == "profileUrl"] or [c for c in df.columns if low[c] == "profileurl"]
    named = named or [c for c in df.columns if low[c] in fv.URL_HEADER_VARIANTS]
    if named:
        return values(df.sparkSession, [(named[0],)], "column")
    found = column_ratio(df, needle).filter(F.col("share") > share)
    return found.agg(F.min_by("column", "pos").alias("column"))


# ---------------------------------------------------------------- projection

def to_schema(df: DataFrame, columns: list[str], mapping: dict[str, str | None], fill: str | None = None, trim: bool = False) -> DataFrame:
    """Target columns in order, as text; unmapped ones are null or ``fill``."""
    def one(target: str) -> Column:
        source = mapping.get(target)
        if not source or source not in df.columns:
            return F.lit(fill).cast("string").alias(target)
        value = F.col(f"`{source}`").cast("string")
        value = tx.strip(value) if trim else value
        return (value if fill is None else F.coalesce(value, F.lit(fill))).alias(target)

    return df.select(*[one(t) for t in columns])


def rename_mapped(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Rename the sources of a target-to-source mapping, keep everything else."""
    return df.withColumnsRenamed({s: t for t, s in mapping.items() if s})


def reorder(df: DataFrame, first: list[str], rest: bool = True) -> DataFrame:
    """Listed columns first, in order, then (optionally) all others."""
    head = [c for c in first if c in df.columns]
    return df.select(*[f"`{c}`" for c in head + ([c for c in df.columns if c not in head] if rest else [])])


def insert_front(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()], "*")


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Append tables, columns in first-seen order, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_helpers(df: DataFrame, prefix: str = "_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


# ---------------------------------------------------------------- validation

def empty_required(df: DataFrame, required: list[str]) -> DataFrame:
    """``(column, empty)``: null or blank values per required column, in one pass."""
    counts = df.agg(*[F.count_if(tx.strip(tx.text(f"`{c}`")) == "").alias(f"_{i}") for i, c in enumerate(required)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("empty")) for i, c in enumerate(required)])
    return counts.select(F.inline(rows))


def bad_urls(df: DataFrame, column: str) -> DataFrame:
    """Number of values that do not start like a web address."""
    return df.agg(F.count_if(~tx.text(column).rlike("(?i)^https?://")).alias("bad"), F.count(F.lit(1)).alias("total"))
