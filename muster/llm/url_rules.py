"""URL filter: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is a host, a path and a verdict; it fits its host and all subdomains
when the URL's path starts with the rule's.  Every distinct place (host and
path) is expanded into the expressions that could be a rule: its host suffixes
with as many labels, and its path prefixes with as many characters, as some
rule has.  Expressions meet rules in an equi-join on the first hex digits of
their SHA-256; the full digest confirms, and the longest rule of a place wins.

Scale: places are counted once per distinct host and path before expansion.
The list of rules is broadcast while its measured size is below
``BROADCAST_BYTES``; beyond that the join shuffles, with frequent hash prefixes
cut into shares in proportion to their rows.  Places go back to their rows the
same way.  The driver learns only which shapes (labels, path characters) rules
have; k different path lengths take rules of k(k-1)/2 characters, so this list
stays small beside the rules.

Defined results: a null URL or one without ``://`` has empty host and path and
fits nothing; what fits nothing gets the default verdict; an empty path starts
with no ``/``; of rules of one text and both verdicts ``block`` counts; of
equally long rules the longer host wins; rules without a host and without a
verdict are left out, a null path is empty; repeated rows get one result each;
very long URLs cost one expression per shape; no rules or an empty table give
default verdicts or no rows.  ``judge`` reads only the named columns;
``keep_allowed`` returns all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from muster.operators.skew import lookup_join

ALLOW, BLOCK = "allow", "block"
#: Rules of at most so many bytes are sent to every executor.
BROADCAST_BYTES = 16 << 20
#: Hex digits of the digest that expressions and rules meet on.
SHORT = 8
RULE = "host string, path string, verdict string"
_PLACE = "://([^/?#]*)([^?#]*)"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def place_of(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path after the first ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return _lower(F.regexp_extract(text, _PLACE, 1)), F.regexp_extract(text, _PLACE, 2)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules ``(host, path, verdict)``."""
    return spark.createDataFrame(rules, RULE)


def rule_table(rules: DataFrame) -> DataFrame:
    """``(short, digest, rule, verdict, labels, reach, host_length)``: one row per rule text."""
    host, path = _lower(F.col("host")), F.coalesce("path", F.lit(""))
    clean = rules.filter(F.col("verdict").isin(ALLOW, BLOCK) & (F.coalesce("host", F.lit("")) != "")).select(
        F.concat(host, path).alias("rule"), "verdict", _labels(host).alias("labels"), F.length(path).alias("reach"),
        F.length(host).alias("host_length"))
    once = clean.groupBy("rule", "labels", "reach", "host_length").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.encode("rule", "UTF-8"), 256)
    return once.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, SHORT))


def expressions(places: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``(place, short, digest)`` of every expression of a place (``place, host, path``) that has the shape of a rule."""
    if not shapes:
        return places.select("place", F.lit("").alias("short"), F.lit("").alias("digest")).limit(0)
    known = F.array(*[F.struct(F.lit(c).alias("labels"), F.lit(n).alias("reach")) for c, n in sorted(shapes)])
    has = _labels(F.col("host"))
    cut = lambda s: F.when(
        (has >= s["labels"]) & (F.length("path") >= s["reach"]),
        F.sha2(F.encode(F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]),
                                 F.call_function("left", F.col("path"), s["reach"])), "UTF-8"), 256))
    digests = F.filter(F.transform(known, cut), lambda d: d.isNotNull())
    return places.filter("host <> ''").select("place", F.explode(F.array_distinct(digests)).alias("digest")).select(
        "place", F.substring("digest", 1, SHORT).alias("short"), "digest")


def fitting_rules(places: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(place, rule, verdict)``: the longest rule of every distinct place that has one."""
    table = rule_table(rules)
    shapes = [(r.labels, r.reach) for r in table.select("labels", "reach").distinct().collect()]
    wanted = table.select("short", F.col("digest").alias("full"), "rule", "verdict", "reach", "host_length")
    size = table.agg(F.sum(F.octet_length("rule") + 128)).first()[0] or 0
    asked = expressions(places, shapes)
    if size <= broadcast_bytes:
        met = asked.join(F.broadcast(wanted), "short")
    else:
        met = lookup_join(asked, wanted, "short", "place", how="inner")
    length = F.struct((F.col("reach") + F.col("host_length")).alias("whole"), "host_length", "rule")
    return met.filter("digest = full").groupBy("place").agg(F.max_by(F.struct("rule", "verdict"), length).alias("best")).select(
        "place", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = ALLOW,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(<id>, url, host, path, rule, verdict)`` per row."""
    host, path = place_of(F.col(f"`{url}`"))
    # The position in the scan only spreads the rows of a frequent place.
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"),
                        F.monotonically_increasing_id().alias("at"))
    # A host holds no slash and a path starts with one, so the two can be told apart.
    rows = rows.withColumn("place", F.concat("host", "path"))
    places = rows.groupBy("place", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = fitting_rules(places, rules, broadcast_bytes)
    out = lookup_join(rows, best, "place", "at", counts=places.select("place", "n"))
    return out.select(F.col("id").alias(id), "url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose URL is allowed, with all their columns."""
    names = pages.columns
    plain = pages.toDF(*[f"c{k}" for k in range(len(names))])
    host, path = place_of(F.col(f"c{names.index(url)}"))
    rows = plain.withColumn("place", F.concat(host, path)).withColumn("at", F.monotonically_increasing_id())
    places = plain.select(host.alias("host"), path.alias("path")).withColumn("place", F.concat("host", "path")).groupBy(
        "place", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = fitting_rules(places, rules, broadcast_bytes).select("place", "verdict")
    kept = lookup_join(rows, best, "place", "at", counts=places.select("place", "n"))
    return kept.filter(F.coalesce("verdict", F.lit(default)) == ALLOW).select(*[f"c{k}" for k in range(len(names))]).toDF(*names)
