"""What the operators hold and move grows with the input only."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from muster.llm import setjoin, tokenize, words
from muster.llm.queries import vocabulary


def near_lines(groups, each):
    """Lines of 40 words near those of their group and to no hub, as one star."""
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(40)]
        for i in range(each):
            out.append(" ".join(base[:i % 4] + [f"x{g}y{i}"] + base[i % 4 + 1:]))
    return ["hub " + " ".join(f"h{k}" for k in range(39))] + out


def test_a_cell_gives_a_line_one_link_to_an_earlier_line(spark):
    lines = near_lines(3, 30)
    found = spark.createDataFrame([(0, 0, i, 0, 40, setjoin.STAR) for i in range(1, len(lines))], setjoin.CANDIDATES)
    units = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "doc long, line int, unit string")

    def sets(block):
        spans = block.spans(words.NOT_SPACE)
        return spans.row, spans.hash

    every = {tuple(r) for r in setjoin.verified(found, units, ["doc", "line"], sets, (80, 100)).collect()}
    few = {tuple(r) for r in setjoin.verified(found, units, ["doc", "line"], sets, (80, 100), later=True).collect()}
    last = lambda links: {max((a, b), (c, d)) for a, b, c, d in links}
    assert last(few) == last(every) == {(i, 0) for i in range(len(lines)) if i not in (0, 1, 31, 61)}
    assert few <= every and len(few) < len(lines) < len(every)


def test_hub_links_are_given_once_per_line(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CELL", 8)
    line = " ".join(f"w{k}" for k in range(40))
    found = spark.createDataFrame([(0, 0, i, 0, 40, setjoin.STAR) for i in range(1, 60)], setjoin.CANDIDATES)
    cells = setjoin._cells(found).collect()
    by_cell = {}
    for r in cells:
        by_cell.setdefault((r["hub_doc"], r["hub_line"], r["i"], r["j"]), []).append((r["part"], r["doc"], r["kind"]))
    rows = [(*c, d, 0, p, k, line) for c in sorted(by_cell) for p, d, k in sorted(by_cell[c])]
    table = pa.table([pa.array(v) for v in zip(*rows)], names=["hub_doc", "hub_line", "i", "j", "doc", "line", "part", "kind", "unit"])

    def sets(block):
        spans = block.spans(words.NOT_SPACE)
        return spans.row, spans.hash

    links = setjoin._settled(table, ["hub_doc", "hub_line", "i", "j"], sets, (80, 100), False, True)
    assert sorted(links.column(0).to_pylist()) == list(range(1, 60)) and len(by_cell) > 30


def test_the_table_of_pieces_is_arrays():
    encode = tokenize.WordTokens(vocabulary())
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(map(chr, 97 + rng.integers(0, 26, 6))) for _ in range(400)) + " the of café 12 x1" for _ in range(50)]
    for turn in range(2):
        for block in words.blocks(pa.array(texts), 20_000):
            ids, counts = encode.encode(block)
            ends = np.cumsum(counts)
            for r in range(block.n):
                assert ids[ends[r] - counts[r]:ends[r]].tolist() == encode.tokenizer.encode(texts[block.first + r], add_special_tokens=False).ids
    held = [v for v in vars(encode).values() if isinstance(v, (np.ndarray, dict))]
    assert all(isinstance(v, np.ndarray) for v in held) and sum(v.nbytes for v in held) < 64 * len(encode.keys) + (1 << 17)
    assert (encode.keys[1:] > encode.keys[:-1]).all() and len(encode.keys) > 15_000


def test_stages_bound_the_batches_that_go_to_python(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(name)
    spark.conf.unset(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    try:
        docs = spark.createDataFrame([(1, "one line of some words", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
        assert corpus_pipeline.line_dedup_stage(spark, docs, "").count() == 1
        texts = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")
        found = [r[0] for r in texts.mapInArrow(sizes, "size long").collect()]
        assert max(found) < 8 << 20 and sum(found) > 20_000_000
        # A size that the session names stays.
        spark.conf.set(name, "1000000")
        corpus_pipeline.line_dedup_stage(spark, docs, "")
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)


def test_few_pairs_of_a_list_are_judged_at_once(spark):
    n = 1500
    rows = spark.createDataFrame([(7, i, i << 32, i, 10 << 32) for i in range(n)], setjoin.ROWS)

    def near(a, b):
        assert len(a["n"]) <= 1 << 19
        return np.abs(a["doc"] - b["doc"]) == 1

    def star(a, b):
        return np.zeros(len(b["n"]), bool)

    found = setjoin.candidates(rows, near, star, (80, 100)).collect()
    assert sorted((r["hub_doc"], r["doc"], r["kind"]) for r in found) == [(i, i + 1, setjoin.PAIR) for i in range(n - 1)]
