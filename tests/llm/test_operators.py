"""Every operator on awkward rows against plain Python, and the empty table."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from muster.llm import (components, decontaminate, html_text, licenses, line_dedup, near_dedup, packing, quality, setjoin, shards,
                        substring_dedup, token_counts, words)
from muster.llm.queries import END_OF_TEXT, vocabulary
from muster.llm.storage import CLEANED, stored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, key long, n long"
_rng = np.random.default_rng(3)
_vocabulary = [f"w{i}" for i in range(60)] + ["The", "of", "café", "don't", "x1y2", "…", "a.b"]


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(_vocabulary[int(i)] for i in rng.integers(0, len(_vocabulary), n))


BASE = prose(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w7", "changed")), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, prose(30, 2) + "\n" + prose(25, 3)),
    (9, prose(25, 3) + "\n\n" + prose(6, 4) + "\n"), (10, "w1 " * 80), (11, prose(3000, 5) + " " + BASE), (None, BASE), (12, BASE + " " + BASE),
    (13, "Released under the MIT License.\n" + prose(12, 6)), (14, "a b\x0bc\x0cd\r\ne   f"), (15, prose(25, 3) + " tail"), (16, "### $$$ |||\n### $$$ |||"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", 7, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_words_of_a_column():
    import pyarrow as pa
    texts = ["Ab c", None, "", "é x-y", "Ab"]
    (block,) = words.blocks(pa.array(texts))
    found = block.spans(words.ALNUM, lower=True)
    assert [block.text(a, b).lower() for a, b in zip(found.starts, found.ends)] == ["ab", "c", "é", "x", "y", "ab"]
    assert found.row.tolist() == [0, 0, 3, 3, 3, 4]
    assert found.hash[0] == found.hash[5] and len(set(found.hash.tolist())) == 5
    assert len(list(words.blocks(pa.array(texts), 2))) > 2


def thue_morse(n):
    """A word of two letters and its complement, which a polynomial modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_tell_patterned_sequences_apart():
    rng = np.random.default_rng(5)
    letters = np.frombuffer("".join(thue_morse(1024)).encode(), np.uint8)
    a, b = words.byte_hashes(letters, np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    pair = rng.integers(1, 2**63, 2).astype(np.uint64)
    values = pair[letters - ord("a")]
    a, b = words.span_hashes(values, np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b
    assert len(set(words.window_hashes(values, np.array([0, 1024]), 1024).tolist())) == 2
    # Equal spans hash alike wherever they stand, all others apart.
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3960, 3000)
    ends = starts + rng.integers(0, 40, 3000)
    seen = {}
    for h, s, e in zip(words.byte_hashes(data, starts, ends).tolist(), starts, ends):
        assert seen.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    assert len(seen) == len({data[s:e].tobytes() for s, e in zip(starts, ends)})
    for size in (1, 2, 5, 20, 31):
        at = np.arange(len(data) - size + 1)
        got = words.window_hashes(data.astype(np.uint64), at, size)
        assert len(set(got.tolist())) == len({data[i:i + size].tobytes() for i in at})
        assert len(set(zip(got.tolist(), (data[i:i + size].tobytes() for i in at)))) == len(set(got.tolist()))


def test_patterned_words_are_different_words(spark):
    one, two = thue_morse(1024)
    start = " ".join(f"v{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {two}"), (3, f"x {one}"), (4, f"x {two}")], "doc_id long, text string")
    assert rows_of(substring_dedup.repeats(df), "doc_id", "n_removed") == [(i, 0) for i in (1, 2, 3, 4)]
    assert all(near for _, near in rows_of(near_dedup.near_duplicates(df.filter("doc_id > 2")), "doc_id", "kept"))
    items = spark.createDataFrame([("a", one)], "item_id string, text string")
    assert [r[0] for r in rows_of(decontaminate.remove_contaminated(df, items), "doc_id")] == [2, 4]
    from muster.llm import tokenize
    from tokenizers import Tokenizer
    import pyarrow as pa
    plain = Tokenizer.from_file(vocabulary())
    (block,) = words.blocks(pa.array([one, two]))
    ids, counts = tokenize.encoder(vocabulary()).encode(block)
    assert ids.tolist() == [i for t in (one, two) for i in plain.encode(t, add_special_tokens=False).ids] and len(counts) == 2


def test_columns_of_any_name_pass_through_the_stages(spark):
    names = ["doc", "_gone", "_GONE", "_text", "_doc", "_left", "line", "a.b", "n`n", "id", "component"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names if n != "_GONE")
    extra = tuple(f"own {n}" for n in names if n != "_GONE")
    line, other = prose(30, 31), prose(30, 32)
    rows = [(1, f"{line}\n{other}", 9, *extra), (2, f"{line}\nshort one", 9, *extra), (3, None, None, *extra), (4, line, 9, *extra)]
    df = spark.createDataFrame(rows, schema)
    left = {r[0]: tuple(r) for r in line_dedup.drop_later_lines(df, drop_emptied=True).collect()}
    assert left == {1: rows[0], 2: (2, "short one", 9, *extra), 3: rows[2]}
    kept = near_dedup.keep_first(df, size=5)
    # The fourth text is the second but for its last two words.
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == set(rows[:3])
    assert {tuple(r) for r in near_dedup.keep_first(df.filter("doc_id <> 2").union(spark.createDataFrame([(9, line, 9, *extra)], schema))).collect()} == {rows[0], rows[2], rows[3]}


def test_near_duplicates_refuse_ratios_their_sketches_do_not_serve(docs):
    for ratio in ((50, 100), (101, 100)):
        with pytest.raises(ValueError):
            near_dedup.near_duplicates(docs, ratio=ratio)


def test_labelled_sample_is_bounded_for_repeated_ids(spark):
    df = spark.range(300).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1.0)], "doc_id long, quality double")
    assert len(quality.labelled_sample(df, labels, rows=10)) == 10


def test_a_document_of_many_lines_takes_time_in_proportion(spark):
    lines = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(32_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(f"{x} end" for x in lines))], "doc_id long, text string")
    begin = time.time()
    out = dict(rows_of(line_dedup.line_report(df), "doc_id", "n_removed"))
    assert out == {1: 0, 2: 32_000}
    # The cost of 121 s was quadratic.
    assert time.time() - begin < 60


def test_leaks(spark, docs, none):
    items = [("a", prose(25, 3)), ("b", "one"), ("c", None), ("d", "..."), ("e", " ".join(BASE.split()[5:30])), ("e", " ".join(BASE.split()[5:30])), (None, prose(12, 9)),
             ("f", "w1 w1 w1")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    expected = []
    for i, t in TEXTS:
        w, hit, names = alnum(t), set(), set()
        for name, text in items:
            x = alnum(text)
            n = min(10, len(x))
            for k in range(len(x) - n + 1) if x else []:
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == x[k:k + n]:
                        hit |= set(range(at, at + n))
                        names.add(name)
        names = sorted(x for x in names if x is not None)
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (decontaminate.BLOCK_WORDS, 20):
        assert rows_of(decontaminate.find_leaks(docs, bench, block_words=block), *columns) == sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not e[-1] for e in expected)
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).filter("contaminated").count() == 0
    found = decontaminate.longest_matches(docs, bench).filter("doc_id = 9 and item_id = 'a' and item_word = 0").collect()
    assert found[0].length == len(alnum(prose(25, 3))) and found[0].word == 0


def test_repeats(spark, docs, none):
    first, judged = {}, []
    for i, t in sorted((x for x in TEXTS if x[0] is not None), key=lambda x: x[0]):
        w, gone = split(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in first:
                gone |= set(range(k, k + 20))
            else:
                first[key] = (i, k)
        judged.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    judged.append((None, len(split(BASE)), 0, hashlib.sha256(BASE.encode()).hexdigest()))
    out = substring_dedup.repeats(docs, with_text=True)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(judged, key=lambda r: (r[0] is not None, r))
    assert substring_dedup.repeats(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=45, max_size=90), st.integers(0, 20))
def test_equal_windows_hold_equal_symbols(noise, at):
    """A window pasted elsewhere is never called new by a symbol that occurs once."""
    import pyarrow as pa
    a = " ".join(f"v{x}" for x in noise)
    b = "q0 q1 " + " ".join(a.split()[at:at + 22]) + " q2"
    (block,) = words.blocks(pa.array([a, b]))
    found = block.spans(words.NOT_SPACE)
    name, lo, hi, _ = substring_dedup.symbols(found)
    count = collections.Counter(name.tolist())
    windows, key = words.windows(found, 20)
    often = collections.Counter(key.tolist())
    for s, k in zip(windows.tolist(), key.tolist()):
        if often[k] > 1:
            assert not any(count[int(x)] == 1 and s <= u and v <= s + 19 for x, u, v in zip(name, lo, hi))


def test_licences(spark, docs, none):
    out = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert out[13].licence == "MIT" and out[13].licences == "MIT" and 2 * out[13].shared == out[13].total
    assert out[4].n_units == 0 and out[4].licence is None and out[8].n_units == 3
    assert licenses.scan(none).count() == 0
    for n in (1, 4, 11):
        lo, hi = licenses.size_bounds(n, 0.8)
        assert all((2 * min(m, n) >= 0.8 * (m + n) - 1e-9) == (lo <= m <= hi) for m in range(1, 60))
    with pytest.raises(ValueError):
        licenses.scan(docs, {"x": "word"})


def test_full_texts_headers_and_spdx_lines_are_licences(spark):
    from importlib import resources
    full = {f.name[:-4]: f.read_text() for f in resources.files("muster.llm").joinpath("licence_texts").iterdir()}
    lines = {"MIT": "# SPDX-License-Identifier: MIT", "AGPL-3.0": "// SPDX-License-Identifier: AGPL-3.0-or-later", "CC0-1.0": "/* SPDX-License-Identifier: CC0-1.0 */",
             "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
                        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."}
    named = [*((k, "Copyright (c) 2020 A. Person\n\n" + v) for k, v in full.items()), *((k, v) for k, v in lines.items())]
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(named)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in licenses.scan(texts).collect()} == {i: k for i, (k, _) in enumerate(named)}
    assert {"MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"} <= set(full)


def test_main_text_of_pages(spark, sf_dir):
    model = html_text.trained()
    held_out = html_text.made_examples(60, 77)
    right = total = 0
    for x, y in held_out:
        right += ((model.scores(*html_text.padded([x]))[0] > 0) == (y > 0)).sum()
        total += len(y)
    assert right / total > 0.95
    page = '<nav><a href="/">Home</a></nav><article><h1>Caf&eacute;</h1><p>A  b<br>c &amp; d.<p>Second one.</article><footer>&copy; x</footer><scr'
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (4, "w", "<script>x")], "page_id long, url string, html string")
    out = html_text.extract(pages, model)
    assert rows_of(out, "page_id", "text", "n_chars") == [(1, "Café\nA b c & d.\nSecond one.", 27)] * 2 + [(2, "", 0), (3, "", 0), (4, "", 0)]
    assert html_text.extract(pages.limit(0), model).count() == 0


def test_all_words_of_a_block_tell_its_kind():
    one, other = (html_text.vectors([(("p",), "the same words stand first in both of these " + last, 0)]) for last in ("cookies", "history"))
    assert (one != other).any()
    model, right, total = html_text.trained(), 0, 0
    for x, y in html_text.made_examples(100, 78, "flat"):
        right += ((model.scores(*html_text.padded([x]))[0] > 0) == (y > 0)).sum()
        total += len(y)
    assert right / total > 0.9


def test_all_names_of_an_attribute_are_read():
    looks = "flex flex-col w-full mt-4 px-2 text-sm bg-white rounded grid gap-4"
    (path, text, _), = html_text.leaves(f'<div class="{looks} comments">x</div>')
    assert ".comments" in path and text == "x"
    plain, marked = (html_text.vectors(html_text.leaves(f'<div class="{looks} {name}">x</div>')) for name in ("", "comments"))
    assert (plain != marked).any()


def stats_of(text):
    w, lines = split(text), (text or "").split("\n")
    grams = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
    worded = [x for x in lines if split(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(worded) - len(set(worded)), len(again))


def test_quality(spark, docs, none):
    out = quality.judge(docs, [])
    expected = [(i, *stats_of(t), stats_of(t)[0] < 10 or 100 * stats_of(t)[4] > 20 * stats_of(t)[0]) for i, t in TEXTS]
    assert rows_of(out, "doc_id", *quality.BASE, "base_failed") == sorted(expected, key=lambda r: (r[0] is not None, r))
    assert out.filter("kept = base_failed").count() == 0 and quality.judge(none, []).count() == 0
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.RATIOS)))
    bad = (x[:, 0] > 0.7) & (x[:, 2] < 0.5)
    rules = quality.learn_rules(x, bad)
    said = np.zeros(600, bool)
    for rule in rules:
        said |= quality._holds(rule, x)
    assert (said == bad).mean() > 0.95
    labels = spark.createDataFrame([(i, None if i == 1 else i % 2, 0) for i in range(1, 17)], "doc_id long, quality int, toxic int")
    assert isinstance(quality.rules_from(docs, labels), list)
    assert quality.rules_from(docs, labels.limit(0)) == []
    kept = quality.keep_good(docs.withColumnRenamed("n", "_q_n_words"), [[quality.Condition(0, True, 0.5)]])
    assert kept.columns == ["doc_id", "text", "lang", "key", "_q_n_words"]


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary())
    texts = TEXTS + [(20, "it's <|endoftext|> WORLD'S ÉCOLE 3rd --'s"), (21, "don't!'s x 12'34 ǅ İ"), (22, "café é #### a—b")]
    out = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), vocabulary(), capacity=64).collect()
    own = collections.defaultdict(list)
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 64):
            own[i].append((k // 64, k, len(ids[k:k + 64]), zlib.crc32(ids[k:k + 64])))
    assert {i: sorted(v) for i, v in own.items()} == {
        i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i) for i in {r.doc_id for r in out}}
    filled = collections.defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 64
    assert packing.pack_documents(none, vocabulary()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 60), max_size=8))
def test_plans_hold_every_piece_once(histogram):
    out = packing.plan(histogram, 50, rounds=40)
    held = collections.Counter()
    for many, parts in out:
        assert many > 0 and sum(l * a for l, a in parts.items()) <= 50
        for length, a in parts.items():
            held[length] += many * a
    assert held == collections.Counter(histogram)
    spaces = []
    for length in sorted(held.elements(), reverse=True):
        fits = [k for k, space in enumerate(spaces) if space >= length]
        k = min(fits, key=lambda k: spaces[k]) if fits else len(spaces)
        spaces[k:k + 1] = [(spaces[k] if fits else 50) - length]
    assert sum(m for m, _ in out) <= 1.05 * len(spaces) + 1


def later(texts, ratio=0.8, least=5):
    units = sorted((i, k, frozenset(split(line))) for i, t in texts if i is not None and t for k, line in enumerate(t.split("\n")) if len(split(line)) >= least)
    return {(i, k) for n, (i, k, s) in enumerate(units) if any(10 * len(s & o) >= 8 * len(s | o) for _, _, o in units[:n])}


def test_lines(spark, docs, none):
    assert {tuple(r) for r in line_dedup.later_lines(docs).collect()} == later(TEXTS)
    out = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert len(out) == len(TEXTS) and out[4].n_lines == 0 and out[2].n_removed == 1 and out[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    kept = line_dedup.drop_later_lines(docs, drop_emptied=True)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id in (4, 5, 6)").count() == 3
    assert line_dedup.line_report(none).count() == 0


def components_of(texts, size, lower=True):
    sets = {}
    for i, t in texts:
        w = split(t, lower)
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    lead = {i: i for i in sets}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                lead[v] = u
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(base, rate, seed):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > rate else f"z{seed}x{k}" for k, w in enumerate(base.split()))


def test_long_lines_are_compared_by_several_maps(spark):
    rng = np.random.default_rng(5)
    sizes = [60, 72, 73, 80, 130, 144, 145, 160, 300, 900]
    lines = []
    for n in sizes:
        words = [f"w{x}" for x in rng.integers(0, 3000, n)]
        for changed in (0.05, 0.09, 0.1, 0.11, 0.12, 0.3):
            other = [f"v{rng.integers(1 << 40)}" if rng.random() < changed else w for w in words]
            lines += [" ".join(words), " ".join(other[: len(other) - int(rng.integers(0, n // 8))])]
    order = rng.permutation(len(lines))
    texts = ["\n".join(lines[k] for k in order[i::12]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units = [(i, k, set(line.split())) for i, text in enumerate(texts) for k, line in enumerate(text.split("\n"))]
    want = {(d, k) for at, (d, k, own) in enumerate(units) if any(100 * len(own & a) >= 80 * len(own | a) for _, _, a in units[:at])}
    assert {tuple(r) for r in line_dedup.later_lines(docs).collect()} == want and len(want) < len(units)


def test_maps_never_tell_more_differing_tokens_than_there_are():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, m = (int(x) for x in rng.integers(5, 320, 2))
        shared = int(rng.integers(0, min(n, m) + 1))
        drawn = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        sizes = np.array([n, m])
        maps = setjoin.wide_signature(np.repeat([0, 1], sizes), np.concatenate([drawn[:n], drawn[:shared], drawn[n:]]), line_dedup.maps_of(sizes)).view(np.int64)
        columns = {"n": sizes, "bits": np.bitwise_or.reduce(maps)} | {f"wide_{k}": line for k, line in enumerate(maps)}
        least, _ = line_dedup.map_sums(setjoin.Part(columns, np.array([0])), setjoin.Part(columns, np.array([1])), lambda x, y: x & ~y)
        assert least[0] <= n - shared


def test_near_duplicates(spark, docs, none):
    expected = components_of([x for x in TEXTS if x[0] is not None], 2)
    out = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items() if i is not None} == expected
    assert out[None].component_id is None and out[None].kept
    base = " ".join(f"u{i}" for i in range(300))
    group = [(i, edited(base, 0.01 + 0.08 * (i % 7) / 7, i)) for i in range(100, 220)] + [(500 + i, prose(8 + i % 5, i)) for i in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(group, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(group, 2)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2").count() == 0 and kept.filter("doc_id is null").count() == 1
    assert near_dedup.near_duplicates(none).count() == 0


def test_maps_of_sets_lose_no_link(spark):
    # Families that share a passage: some of their pairs reach the threshold, most do not.
    rng = np.random.default_rng(8)
    group = []
    for size in (8, 22, 26, 40, 90, 180, 200, 260):
        passage = [f"p{size}x{i}" for i in range(size)]
        for extra in (0.0, 0.05, 0.1, 0.11, 0.12, 0.13, 0.2, 0.6, 1.0):
            words = passage + [f"e{rng.integers(1 << 40)}" for _ in range(int(extra * size))]
            group += [(len(group), " ".join(words)), (len(group) + 1, edited(" ".join(words), 0.03, len(group) + 1))]
    got = near_dedup.near_duplicates(spark.createDataFrame(group, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(group, 2)


def test_large_stars_are_cut_in_cells(spark, monkeypatch):
    base = " ".join(f"u{i}" for i in range(200))
    group = [(i, edited(base, 0.02 + 0.1 * (i % 5) / 5, i)) for i in range(1, 61)]
    monkeypatch.setattr(setjoin, "CELL", 8)
    got = near_dedup.near_duplicates(spark.createDataFrame(group, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in components_of(group, 2).items()}


def test_hot_lists_are_dealt_over_a_grid(monkeypatch):
    monkeypatch.setattr(setjoin, "HOT", 10)
    keys, units = np.full(50, 9, np.uint64), np.arange(50, dtype=np.uint64)
    rows, dealt = setjoin.dealt(keys, np.full(50, 50), units)
    cells = collections.defaultdict(set)
    for r, k in zip(rows.tolist(), dealt.tolist()):
        cells[k].add(r)
    assert all(any({a, b} <= c for c in cells.values()) for a in range(50) for b in range(a))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (7, 8), (5, 5), (10, 4), (9, 1)] + [(k, k + 1) for k in range(20, 45)], "a long, b long")
    got = {r.id: r.component for r in components.component_of(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, 10: 4, 4: 4} | {k: 20 for k in range(20, 46)}


def test_shards(spark, docs, none):
    out = shards.with_shard(docs, 4).collect()
    size = {i: len((t or "").encode()) + 8 for i, t in TEXTS}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in TEXTS}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (size[i], crc[i]) for i in size}
    order = sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.shard for r in order] == sorted(r.shard for r in out)
    for s in range(4):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in out)))
    target = sum(size.values()) / 4
    assert all(abs(sum(r.size for r in out if r.shard == s) - target) <= max(size.values()) for s in range(4))
    assert shards.with_shard(none, 4).count() == 0


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary())
    expected = sorted(((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids), True) for i, t in TEXTS), key=lambda r: (r[0] is not None, r))
    for block in (token_counts.BLOCK_IDS, 7):
        streams = token_counts.write_streams(docs, vocabulary(), END_OF_TEXT, block_ids=block)
        assert rows_of(token_counts.count_tokens(streams, END_OF_TEXT), "doc_id", "n_tokens", "complete") == expected
    open_end = spark.createDataFrame([(0, 0, bytearray(np.array([5, 9, 5, 5], "<u4")), [1]), (0, 1, bytearray(np.array([6], "<u4")), [])], token_counts.STREAM)
    assert rows_of(token_counts.count_tokens(open_end, 9), "doc_id", "n_tokens", "complete") == [(None, 3, False), (1, 1, True)]
    assert token_counts.count_tokens(token_counts.write_streams(none, vocabulary(), END_OF_TEXT), END_OF_TEXT).count() == 0
    assert stored(none).columns == none.columns


def test_texts_that_hold_the_separator_are_counted(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary())
    texts = [(1, "one two"), (2, "it's <|endoftext|> here<|endoftext|>"), (3, "<|endoftext|>"), (4, ""), (5, "three"), (6, "<|ENDOFTEXT|> x")]
    expected = [(i, len(tokenizer.encode(t, add_special_tokens=False).ids), True) for i, t in texts]
    assert END_OF_TEXT in tokenizer.encode(texts[1][1], add_special_tokens=False).ids
    for block in (token_counts.BLOCK_IDS, 3):
        streams = token_counts.write_streams(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), vocabulary(), END_OF_TEXT, block_ids=block)
        assert rows_of(token_counts.count_tokens(streams, END_OF_TEXT), "doc_id", "n_tokens", "complete") == expected


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffled():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    setting, before = spark.conf.get(CLEANED, None), shuffled()
    kept = stored(spark.range(1000).repartition("id").selectExpr("id % 7 as k").groupBy("k").count(), "cleaned")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(CLEANED, None) == setting
    assert sum(r[1] for r in kept.collect()) == 1000


def test_only_compared_lines_are_cut(spark):
    texts = [(1, "a\n\nb\u00e9\nc"), (1, "x\ny"), (2, None), (3, "z"), (-4, "k\nl")]
    found = [(-4, 1, 1, 0), (-4, 1, 1, 2), (1, 2, 1, 3)]
    out = line_dedup.compared_lines(spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(found, "hub_doc long, hub_line int, doc long, line int"))
    assert sorted(map(tuple, out.collect())) == [(-4, 1, "l"), (1, 0, "a"), (1, 0, "x"), (1, 2, "b\u00e9"), (1, 3, "c")]


def test_order_by_is_the_order_of_the_whole_keys():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 3, 500):
        for high in (1, 3, 1 << 20, 1 << 63):
            keys = [rng.integers(0, high, n, dtype=np.uint64), rng.integers(0, 4, n).astype(np.int32), rng.integers(0, 1 << 63, n), np.repeat(rng.integers(0, 9, n), 1)]
            for some in (keys, keys[::-1], keys[:1], keys[1:2]):
                assert (setjoin.order_by(*some) == np.lexsort(some[::-1])).all()
