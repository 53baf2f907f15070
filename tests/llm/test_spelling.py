"""Spelling variants against the edits themselves."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from muster.llm import spelling


def expected(counts, times=10):
    """Near words by deleting every letter of every word."""
    near, by = collections.defaultdict(set), collections.defaultdict(list)
    for word in counts:
        for k in range(len(word)):
            by[k, word[:k] + word[k + 1:]].append(word)
    for (_, rest), words in by.items():
        for word in words:
            near[word].update(w for w in words if w != word)
            if rest in counts:
                near[word].add(rest)
                near[rest].add(word)
    forms = {}
    for word, others in near.items():
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        if best is not None and counts[best] >= times * counts[word]:
            forms[word] = best
    rows = []
    for word, n in counts.items():
        root = word
        while root in forms:
            root = forms[root]
        rows.append((word, forms.get(word), root, n, len(near[word]), counts.get(forms.get(word))))
    return sorted(rows)


def groups(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return sorted(map(tuple, spelling.spelling_groups(words, **options).collect()))


def vocabulary(size, seed, letters="abcdé"):
    rng = np.random.default_rng(seed)
    words = {"".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(7, 11))) for _ in range(size)}
    return {w: int(10 ** rng.uniform(0.3, 4)) for w in sorted(words)}


@pytest.mark.parametrize("options", [{}, {"cell_words": 40, "sample_words": 300}])
def test_groups_equal_all_edits(spark, options):
    counts = vocabulary(3000, 1, "abc") | {"colours": 5000, "colors": 3, "coloursé": 50, "colourse": 4}
    assert groups(spark, counts, **options) == expected(counts)


def test_chains_end_at_their_root(spark):
    chain = {"aaaaaaa" + "b" * k: 10 ** (k + 1) for k in range(9)}
    got = groups(spark, chain)
    assert got == expected(chain) and {r[2] for r in got} == {"aaaaaaa" + "b" * 8}


def test_anagrams_are_cut_by_hash(spark):
    rng = np.random.default_rng(4)
    words = {"".join(rng.permutation(list("abcdefgh"))) for _ in range(1500)} | {"".join(rng.permutation(list("abcdefgi"))) for _ in range(1500)}
    counts = {w: int(rng.integers(2, 100)) for w in sorted(words)}
    assert groups(spark, counts, cell_words=100, sample_words=1000) == expected(counts)


def test_equal_counts_take_the_first_word(spark):
    counts = {"worders": 2, "wordera": 50, "worderé": 50, "worderz": 50}
    assert [r[1] for r in groups(spark, counts) if r[0] == "worders"] == ["wordera"]


def test_counted_words(spark):
    texts = [(1, "Colours ÉCLAIRS colours, naïveté-naïveté"), (2, None), (3, ""), (4, "short words only 1234567"), (None, "Colours"),
             (5, "x" * 30_000 + " " + "x" * 30_000)] + [(k, "perambulate Perambulate") for k in range(6, 200)] * 2
    want = collections.Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run
            if len(word) >= 7:
                want[word] += 1
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n int, word string").repartition(3)
    got = {r.word: r.n for r in spelling.counted_words(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert groups(spark, got) == expected(got)


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(spelling.counted_words(docs)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(st.sampled_from("abc"), min_size=3, max_size=6), min_size=1), st.integers(0, 3))
def test_tops_send_every_near_pair_to_one_cell(words, cell_words):
    by = collections.defaultdict(list)
    for w in sorted(words):
        by[len(w)].append(w)
    tops, cell = {}, 0
    for length, some in by.items():
        tops[length], cell = spelling.build_top(spelling.counts_of(spelling.letters_of(some, length)), len(some), cell, cell_words + 1)

    def reached(word, target, up, down):
        found = tops[target].cells(spelling.counts_of(spelling.letters_of([word], len(word))), up, down)
        return {first + k for _, first, parts in found for k in range(parts)}

    near = {(r[0], w) for r in expected(dict.fromkeys(words, 2)) for w in words
            if len(w) - len(r[0]) in (0, 1) and w != r[0] and any(w[:k] + w[k + 1:] in (r[0][:k] + r[0][k + 1:] if len(w) == len(r[0]) else r[0],)
                                                              for k in range(len(w)))}
    for a, b in near:
        home = reached(b, len(b), 0, 0)
        assert home <= reached(a, len(b), 1, int(len(a) == len(b)))
