"""Company matching: counts, audits, cascades and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import text as tx
from muster.operators.dedupe import distinct_names
from muster.operators.fuzzy_join import best_match, best_match_any
from muster.operators.report import distinct_by_id
from muster.operators.skew import key_counts, lookup_join, pair_join, spread
from muster.plans.storage import cut_lineage


def first_positions(df: DataFrame, key: str, pos: str) -> DataFrame:
    """``(key, pos)``: every non-empty key once, at its first position."""
    return df.filter(F.col(key) != "").groupBy(F.col(key).alias("key")).agg(F.min(pos).alias("pos"))


def matched_keys(keys: DataFrame, reference: DataFrame, scorer: str = "token_set", threshold: float = 92,
                 fuzzy: bool = True) -> DataFrame:
    """``(key, match, pos, score)`` of keys that find a reference entry."""
    if fuzzy:
        return best_match(keys, reference, scorer, threshold)
    return keys.join(reference, "key").select("key", F.col("key").alias("match"), "pos", F.lit(100.0).alias("score"))


def match_counts(contacts: DataFrame, company: Column, reference: DataFrame, name: Column, pos: str = "pos",
                 **options) -> DataFrame:
    """Reference rows with the number and percentage of contacts they match.

    Contacts are counted per distinct key first, so only those counts meet the
    reference.
    """
    per_key = cut_lineage(contacts.groupBy(company.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    ref = reference.withColumn("_key", name)
    best = matched_keys(per_key.select("key").filter("key <> ''"), first_positions(ref, "_key", pos), **options)
    hits = per_key.join(best, "key").groupBy("pos").agg(F.sum("n").alias("matched_contacts"))
    total = contacts.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = ref.drop("_key").join(hits.withColumnRenamed("pos", pos), pos, "left").withColumn("_total", total)
    matched = F.coalesce("matched_contacts", F.lit(0))
    return counted.withColumn("matched_contacts", matched).withColumn(
        "pct_of_contacts", tx.rate(F.col("matched_contacts"), F.col("_total"), 2, 100.0)
    ).drop("_total")


def match_audit(contacts: DataFrame, company: Column, reference: DataFrame, name: Column, pos: str = "pos",
                entry: str = "name", **options) -> DataFrame:
    """Every matched contact with its reference entry (column ``entry``) and whole-number score."""
    keyed = contacts.withColumn("key", company)
    counts = cut_lineage(key_counts(keyed, "key"))
    ref = reference.withColumn("_key", name)
    best = matched_keys(counts.select("key").filter("key <> ''"), first_positions(ref, "_key", pos), **options)
    named = best.join(reference.select(F.col(pos).alias("pos"), F.col(entry).alias("matched_name")), "pos")
    table = named.select("key", "matched_name", F.floor("score").alias("score"))
    return lookup_join(keyed, table, "key", how="inner", counts=counts).drop("key")


def with_list_scores(df: DataFrame, lists: dict[str, tuple[str, DataFrame, float]], normalise=tx.nfkc_lower,
                     row_id: str = "row_id", below: bool = True) -> DataFrame:
    """Best entry of a list for a value, its score, and whether that suffices.

    ``lists`` maps each flag to (column, ``wanted(name, pos)``, threshold).  The
    entry stands in ``<flag>_best`` as it was compared, the score in ``<flag>_score``; a blank value has no entry and scores 0.
    ``below=False`` saves the search for entries below the threshold.
    Values are counted, normalised and matched once per distinct spelling, all
    on the untouched input; the rows are then looked up list by list.
    """
    tables = {}
    for out, (column, wanted, threshold) in lists.items():
        counts = cut_lineage(key_counts(df, column))
        spellings = counts.withColumn("key", normalise(column)).filter("key <> ''")
        right = first_positions(wanted.withColumn("_key", normalise("name")), "_key", "pos")
        keys = spellings.select("key").distinct()
        best = (best_match_any(keys, right, "token_set") if below else best_match(keys, right, "token_set", threshold)).select(
            "key", F.col("match").alias(f"{out}_best"), F.col("score").alias(f"{out}_score"), (F.col("score") >= threshold).alias(out))
        tables[out] = (column, counts, cut_lineage(spellings.join(best, "key").select(column, out, f"{out}_best", f"{out}_score")))
    for out, (column, counts, table) in tables.items():
        df = lookup_join(df, table, column, row_id, counts=counts).fillna({out: False, f"{out}_score": 0.0})
    return df


def key_index(contacts: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """``(row_id, source, raw, key)``: one row per contact and distinct company key.

    The columns of one contact sit side by side, so duplicate keys go away
    inside the row; nothing is shuffled.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("nth"), F.lit(c).alias("source"), F.col(c).alias("raw"), tx.match_key(c).alias("key"))
        for i, c in enumerate(columns)
    ])
    filled = F.filter(cells, lambda e: tx.strip(e["raw"]) != "")
    keys = F.transform("cells", lambda e: e["key"])
    first = F.filter("cells", lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return contacts.select(row_id, filled.alias("cells")).select(row_id, F.inline(first))


def known_keys(index: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """``(key, pos, n)``: every key of an index with its first position and its number of rows."""
    place = F.col(row_id) * len(columns) + F.col("nth")
    return cut_lineage(index.groupBy("key").agg(F.min(place).alias("pos"), F.count(F.lit(1)).alias("n")))


def matched_targets(targets: DataFrame, counts: DataFrame, target: str = "company", scorer: str = "token_set", cutoff: float = 88,
                    include_empty: bool = False) -> DataFrame:
    """Targets with the one ``key`` of ``counts`` they match and its ``match_type``: an equal key, else the best similar one."""
    wanted = targets.withColumn("_tkey", tx.match_key(target))
    wanted = wanted.filter(F.col(target).isNotNull())
    known = counts.select("key", "pos")
    if not include_empty:
        wanted, known = wanted.filter("_tkey <> ''"), known.filter("key <> ''")
    names = wanted.select(F.col("_tkey").alias("key")).distinct()
    exact = names.join(known, "key", "left_semi").select(F.col("key").alias("_tkey"), "key", F.lit("exact").alias("match_type"))
    open_ = names.join(known, "key", "left_anti")
    label = F.concat(F.lit(f"fuzzy:{scorer}_ratio:" if scorer != "ratio" else "fuzzy:ratio:"), F.col("score").cast("string"))
    fuzzy = best_match(open_, known, scorer, cutoff).select(
        F.col("key").alias("_tkey"), F.col("match").alias("key"), label.alias("match_type")
    )
    return wanted.join(exact.unionByName(fuzzy), "_tkey").drop("_tkey")


def match_targets(targets: DataFrame, contacts: DataFrame, columns: list[str], target: str = "company",
                  row_id: str = "row_id", people: DataFrame | None = None, **options) -> DataFrame:
    """Contacts of every target: equal keys, else all sharing the best similar key.

    Returns target columns, ``match_type``, ``source``, ``raw`` and ``row_id``,
    and the columns that ``people`` holds by ``row_id``.  These join the contacts
    before the targets do: each target repeats its contacts, and so many rows
    need no second join.
    """
    numbered = lambda df: cut_lineage(df.withColumn("_number", F.monotonically_increasing_id()))
    index = numbered(key_index(spread(contacts), columns, row_id))
    counts = known_keys(index, columns, row_id)
    pairs = numbered(matched_targets(targets, counts, target, **options))
    sides = counts.join(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key").select("key", "n", "m")
    rows = index.drop("nth")
    if people is not None:
        rows = rows.join(people, row_id, "left")
    return pair_join(rows, pairs, "key", sides, "_number").drop("key")


def match_people(targets: DataFrame, contacts: DataFrame, columns: list[str], people: DataFrame, ids: list[str],
                 target: str = "company", row_id: str = "row_id", **options) -> DataFrame:
    """``(target, contacts)``: how many distinct people ``match_targets`` finds for every target name.

    All targets of a key have the same contacts, so people are told apart once
    per key and the work is linear: the pairs of targets and contacts are never made.
    """
    index = cut_lineage(key_index(spread(contacts), columns, row_id))
    counts = known_keys(index, columns, row_id)
    pairs = cut_lineage(matched_targets(targets.select(target).distinct(), counts, target, **options).select(target, "key"))
    found = index.select("key", row_id).join(pairs.select("key").distinct(), "key", "left_semi").join(people, row_id, "left")
    return pairs.join(distinct_by_id(found, "key", ids), "key").drop("key")


def with_match_counts(targets: DataFrame, counts: DataFrame, key: str, n: str = "contacts",
                      out: str = "number_of_matches") -> DataFrame:
    """Targets with their number of matches, 0 where there are none."""
    return targets.join(counts.select(key, F.col(n).alias(out)), key, "left").fillna(0, [out])


def without_match(summary: DataFrame, n: str = "number_of_matches") -> DataFrame:
    return summary.filter(F.col(n) == 0)


def apply_alias(df: DataFrame, name: str, aliases: DataFrame, out: str, row_id: str = "row_id") -> DataFrame:
    """Replace names listed in ``aliases(variant, canonical)``, ignoring case."""
    known = alias_table(aliases).withColumnRenamed("key", "_alias")
    joined = lookup_join(df.withColumn("_alias", F.lower(name)), known, "_alias", row_id)
    return joined.withColumn(out, F.coalesce("canonical", F.col(name))).drop("_alias", "canonical")


def alias_table(aliases: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(key, canonical)``: the last entry of a variant counts."""
    return aliases.groupBy(F.lower("variant").alias("key")).agg(F.max_by("canonical", row_id).alias("canonical"))


def apply_mapping(df: DataFrame, name: str, mapping: DataFrame, out: str, fallback: Column,
                  row_id: str = "row_id") -> DataFrame:
    """Standard name from ``mapping(original, standard)``, else ``fallback``."""
    table = mapping.select(F.col("original").alias(name), F.col("standard").alias("_standard"))
    return lookup_join(df, table, name, row_id).withColumn(out, F.coalesce("_standard", fallback)).drop("_standard")


def override_mapping(mapping: DataFrame, prior: DataFrame) -> DataFrame:
    """Earlier reviewed names win over proposed ones."""
    kept = prior.select("original", F.col("standard").alias("_prior"))
    return mapping.join(kept, "original", "left").withColumn("standard", F.coalesce("_prior", "standard")).drop("_prior")


def brand_entities(names: DataFrame, name: str, aliases: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``(key, display, pos, variants)``: entities behind a list of names."""
    clean = distinct_names(names, name, row_id)
    keyed = apply_alias(clean, name, aliases, "_named", row_id).withColumn("key", tx.brand_core("_named"))
    return keyed.groupBy("key").agg(
        F.min_by(name, row_id).alias("display"), F.min(row_id).alias("pos"), F.count(F.lit(1)).alias("variants")
    )


def target_coverage(requests: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = 88,
                    sponsor: str = "sponsor", target: str = "target", row_id: str = "row_id") -> DataFrame:
    """Every requested target with its best entity, score and inclusion.

    The score is reported even below the threshold.
    """
    clean = requests.filter(tx.strip(target) != "").groupBy(sponsor, F.lower(tx.strip(target)).alias("_low")).agg(
        F.min_by(tx.strip(target), row_id).alias(target), F.min(row_id).alias(row_id)
    ).drop("_low")
    keyed = apply_alias(clean, target, aliases, "_named", row_id).withColumn("target_core", tx.brand_core("_named"))
    best = best_match_any(keyed.select(F.col("target_core").alias("key")).distinct(), entities.select("key", "pos").filter("key <> ''"))
    shown = best.join(entities.select("pos", "display"), "pos").select(
        F.col("key").alias("target_core"), F.col("display").alias("best_match"), F.col("score")
    )
    out = keyed.drop("_named").join(shown, "target_core", "left")
    score = F.coalesce("score", F.lit(0.0))
    included = F.col("best_match").isNotNull() & (score >= threshold)
    return out.select(
        sponsor, row_id, target, "target_core", F.coalesce("best_match", F.lit("")).alias("best_match"),
        F.bround(score, 1).alias("match_score"), F.when(included, "Yes").otherwise("No").alias("included"),
    )


def missing_by(coverage: DataFrame, sponsor: str = "sponsor", target: str = "target") -> DataFrame:
    """Targets nobody holds, with the sponsors that asked for them.

    Distinct pairs come first; a row then gathers at most one entry per sponsor.
    """
    missing = coverage.filter("included = 'No'").select(target, sponsor).distinct()
    return missing.groupBy(F.col(target).alias("missing_company")).agg(
        F.array_join(F.array_sort(F.collect_list(sponsor)), ", ").alias("requested_by")
    ).orderBy(F.lower("missing_company"), "missing_company")
