"""Quality rules: an ordered decision list learned from labelled statistics.

Statistics of every text come from one pass over its bytes.  On a bounded
sample of labelled rows, sequential covering grows conjunctions of thresholds
by information gain on two thirds of the sample, prunes them on the last third,
and keeps those that are precise there.  The list is then one Spark conditional
expression: the first rule that holds rejects, else the document stays.

Defined results: null text counts as empty and fails the base rule (fewer than
ten words); labels that are null or whose document is missing are not used,
repeated labels of a document are averaged (0.5 counts as good); without labels
of both kinds there are no rules and only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from muster.llm.words import Block, NOT_LF, NOT_SPACE, blocks, covered, int64, mix, per_row, windows

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_distinct_words", "n_upper", "n_exclaim", "n_digits")
#: Learnt from at most this many labelled rows, those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
#: Features: name, numerator, denominator.
RATIOS = (
    ("symbols_per_word", "n_symbols", "n_words"), ("repeated_share", "n_repeat_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"), ("chars_per_word", "word_chars", "n_words"),
    ("distinct_share", "n_distinct_words", "n_words"), ("upper_share", "n_upper", "word_chars"),
    ("exclaims_per_word", "n_exclaim", "n_words"), ("digit_share", "n_digits", "word_chars"),
    ("words_per_line", "n_words", "n_lines"),
)
_symbols = np.zeros(256, bool)
_symbols[[ord(c) for c in "#*$%&|<>"]] = True


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """The statistics of every row of a block."""
    data, offsets, n = block.data, block.offsets, block.n

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def within(row: np.ndarray, key: np.ndarray) -> np.ndarray:
        return mix(key ^ mix(row.astype(np.uint64) + np.uint64(1)))

    inside, lead = NOT_SPACE[data], (data & 0xC0) != 0x80
    words, lines = block.spans(NOT_SPACE), block.spans(NOT_LF)
    nonblank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=nonblank[1:])
    worded = nonblank[lines.ends] > nonblank[lines.starts]
    line_row, line_key = lines.row[worded], within(lines.row, lines.hash)[worded]
    n_lines = per_row(line_row, n)
    _, first = np.unique(line_key, return_index=True)
    _, first_word = np.unique(within(words.row, words.hash), return_index=True)
    at, key = windows(words, 5)
    _, group, count = np.unique(within(words.row[at], key), return_inverse=True, return_counts=True)
    again = covered(at[count[group] > 1], 5, len(words))
    return {
        "n_words": per_row(words.row, n), "word_chars": total(inside & lead), "n_symbols": total(_symbols[data]),
        "n_dup_lines": n_lines - per_row(line_row[first], n), "n_repeat_words": per_row(words.row[again], n),
        "n_chars": total(lead), "n_lines": n_lines, "n_distinct_words": per_row(words.row[first_word], n),
        "n_upper": total((data >= 0x41) & (data <= 0x5A)), "n_exclaim": total(data == 0x21),
        "n_digits": total((data >= 0x30) & (data <= 0x39)),
    }


def with_stats(df: DataFrame, text: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``df`` with one column per statistic, named with ``prefix``."""
    names = [*BASE, *MORE]
    schema = StructType([f for f in df.schema if keep_text or f.name != text] + [StructField(prefix + x, LongType()) for x in names])
    place = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != place]

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(place)):
                stats = block_stats(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(block.first, block.n) for i in kept] + [int64(stats[x]) for x in names], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    """``numerator / denominator`` above or below a threshold."""

    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] < self.threshold

    def column(self, prefix: str = "") -> Column:
        _, top, bottom = RATIOS[self.feature]
        value = F.col(prefix + top) / F.greatest(F.col(prefix + bottom), F.lit(1))
        return value > F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{RATIOS[self.feature][0]} {'>' if self.above else '<'} {self.threshold:.6g}"


def _holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _candidates(x: np.ndarray, cuts: int) -> list[Condition]:
    found = []
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 2)[1:-1])) if len(x) else []
        found += [Condition(f, up, float(e)) for e in edges for up in (True, False)]
    return found


def _grow(x: np.ndarray, y: np.ndarray, cuts: int, longest: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and y[inside].any() and not y[inside].all():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for c in _candidates(x[inside & y], cuts) + _candidates(x[inside], cuts):
            hit = inside & c.holds(x)
            p, n = (hit & y).sum(), (hit & ~y).sum()
            if p and (g := p * (np.log2(p / (p + n)) - base)) > gain:
                best, gain = c, g
        if best is None:
            break
        # Half way between the classes, where the cut separates them.
        hit, v = best.holds(x), x[:, best.feature]
        if (inside & hit & y).any() and (inside & ~hit & ~y).any():
            bad, good = v[inside & hit & y], v[inside & ~hit & ~y]
            near, far = (bad.min(), good.max()) if best.above else (bad.max(), good.min())
            if (near > far) == best.above and near != far:
                best = Condition(best.feature, best.above, float((near + far) / 2))
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _worth(rule: list[Condition], x: np.ndarray, y: np.ndarray) -> float:
    hit = _holds(rule, x)
    p, n = (hit & y).sum(), (hit & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.95, least: int = 5, cuts: int = 24,
                longest: int = 4, most: int = 12) -> list[list[Condition]]:
    """Sequential covering: rules for the bad rows, the strongest first.

    A rule must be right for ``precision`` of the rows it covers in the whole
    sample and cover ``least`` bad ones.
    """
    order = np.random.default_rng(7).permutation(len(x))
    left = np.ones(len(x), bool)
    grow = np.zeros(len(x), bool)
    grow[order[: len(x) * 2 // 3]] = True
    rules: list[list[Condition]] = []
    while len(rules) < most and (left & bad).sum() >= least:
        a, b = left & grow, left & ~grow
        rule = _grow(x[a], bad[a], cuts, longest)
        while len(rule) > 1 and _worth(rule[:-1], x[b], bad[b]) >= _worth(rule, x[b], bad[b]):
            rule = rule[:-1]
        hit = left & _holds(rule, x) if rule else ~left
        right, n = (hit & bad).sum(), hit.sum()
        if not rule or right < least or right < precision * n:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def features(stats) -> np.ndarray:
    """Feature matrix of a pandas table of statistics."""
    return np.stack([stats[top].to_numpy(float) / np.maximum(stats[bottom].to_numpy(float), 1) for _, top, bottom in RATIOS], axis=1)


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """Statistics and label of at most ``rows`` documents, as pandas.

    Rows of one id share its label; of a repeated id so many go in that the
    bound holds, in an order that depends on the texts alone.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("_quality")).dropna()
        .groupBy("doc_id").agg(F.avg("_quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` ids: small enough to send to every task.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    stats = with_stats(texts, keep_text=False)
    drawn = stats.orderBy(F.xxhash64("doc_id"), "doc_id", *[c for c in stats.columns if c != "doc_id"]).limit(rows)
    return drawn.toPandas().sort_values("doc_id", kind="stable")


def rules_from(documents: DataFrame, labels: DataFrame, **options) -> list[list[Condition]]:
    """Rules learnt from the labelled documents."""
    sample = labelled_sample(documents, labels)
    # The base rule needs no learning.
    sample = sample[(sample["n_words"] >= 10) & (100 * sample["n_repeat_words"] <= 20 * sample["n_words"])]
    bad = (sample["_quality"] < 0.5).to_numpy()
    if not len(sample) or bad.all() or not bad.any():
        return []
    return learn_rules(features(sample), bad, **options)


def rule_number(rules: list[list[Condition]], prefix: str = "") -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        both = rule[0].column(prefix)
        for c in rule[1:]:
            both = both & c.column(prefix)
        out = F.when(both, i) if out is None else out.when(both, i)
    return F.lit(None).cast("int") if out is None else out


def base_failed(prefix: str = "") -> Column:
    """Fewer than ten words, or over a fifth of them in repeated 5-word windows."""
    n = F.col(prefix + "n_words")
    return (n < 10) | (F.col(prefix + "n_repeat_words") * 100 > n * 20)


def judge(documents: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Statistics and verdict per document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_stats(texts, keep_text=False).select(
        "doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & rule_number(rules).isNull()).alias("kept"),
        rule_number(rules).alias("rule"))


def keep_good(documents: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The documents that pass, all columns as they were."""
    prefix = "_q_"
    while any(c.startswith(prefix) for c in documents.columns):
        prefix = "_" + prefix
    return with_stats(documents, prefix=prefix).filter(~base_failed(prefix) & rule_number(rules, prefix).isNull()).select(*documents.columns)
