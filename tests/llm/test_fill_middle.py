"""Fill-in-middle against plain Python, code point by code point."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from muster.llm import fill_middle

TEXTS = [
    (1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n"), (5, "\n\n\n"), (6, "é\n𝄞x\n€"), (7, "no break"), (8, "holds <S> itself\nand more"),
    (9, "half <S\n><P\nM>"), (10, "a\r\nb\r\n"), (10, "a\r\nb\r\n"), (None, "x\ny\nz"), (11, "ü" * 5000 + "\n" + "a" * 5000 + "\n" + "𝄞\n" * 3000),
] + [(i, "\n".join(["é<", "P>ab", "𝄞", ""][k % 4] * (k % 3 + 1) for k in range(i))) for i in range(12, 40)]


def units(text, unit):
    return re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def expected(doc_id, text, unit="line", seed=7, fim_rate=100, spm_rate=50):
    text, parts = text or "", units(text or "", unit)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(parts) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (parts[:lo], parts[lo:hi], parts[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return doc_id, len(parts), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, len(parts), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(parts), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("options", [{}, {"unit": "char"}, {"seed": 11, "fim_rate": 50, "spm_rate": 10}])
def test_forms_equal_plain_python(spark, options):
    docs = spark.createDataFrame([(i, "clash", t, 1) for i, t in TEXTS], "doc_id long, form string, text string, cut int").repartition(3)
    made = fill_middle.fill_in_middle(docs, **options)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, made.collect()), key=key) == sorted((expected(i, t, **options) for i, t in TEXTS), key=key)


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_texts_are_rebuilt_exactly(spark, unit):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = sorted(r.restored_sha256 for r in fill_middle.digests(docs, unit=unit).collect())
    assert got == sorted(sha(t) for _, t in TEXTS)


def test_no_rows(spark):
    assert fill_middle.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unknown_units_are_refused(spark):
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="word")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\né€𝄞<>"), max_size=30)))
def test_positions_convert_both_ways(texts):
    data = "".join(texts).encode()
    index = fill_middle.Exceptions(np.frombuffer(data, np.uint8))
    borders = np.array([len("".join(texts)[:k].encode()) for k in range(len("".join(texts)) + 1)])
    assert index.chars(borders).tolist() == list(range(len(borders)))
    assert index.bytes(np.arange(len(borders))).tolist() == borders.tolist()
    assert len(index.at) == sum(ord(c) > 127 for t in texts for c in t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab\né€𝄞"), max_size=20), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1),
       st.sampled_from(fill_middle.UNITS))
def test_cuts(rows, unit):
    texts, h1, h2 = zip(*rows)
    out = fill_middle.cuts_of(pa.array(texts), np.array(h1, np.int64), np.array(h2, np.int64), unit).to_pylist()
    for text, a, b, cut in zip(texts, h1, h2, out):
        parts = units(text, unit)
        lo, hi = sorted((a % (len(parts) + 1), b % (len(parts) + 1)))
        prefix, both = "".join(parts[:lo]), "".join(parts[:hi])
        assert list(cut.values()) == [len(parts), len(prefix.encode()), len(both.encode()), len(prefix), len(both) - len(prefix)]
