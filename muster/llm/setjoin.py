"""Set-similarity joins: inverted lists to candidates, candidates to verified links.

A list holds the units (documents or lines) that share a key.  Its earliest
unit is its hub.  Units whose signature is near the hub's form the hub's star;
pairs inside a star are settled together in small cells, with the whole sets at
hand, so a group of near copies never becomes a table of pairs.  All other
pairs of a list that pass the length, position and signature filters are
candidates of their own, if enough lists hold them.  Filters only drop pairs
that cannot reach the threshold; which units belong to a star is settled by the
two units alone, whatever the list, and has no bearing on the result.

Lists are found by sorting a shuffle partition with numpy.  A key expected to
be in more than ``HOT`` units is dealt over a grid of cells: chunks of its
units, every pair of chunks in one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from muster.llm.words import U64, blocks, int64, mix

HOT = 1 << 20
#: A pair takes about 120 bytes while it is judged.
PAIRS_AT_ONCE = 1 << 19
#: A chunk of a star holds about so many set elements, and at most so many units.
ELEMENTS, CELL = 1 << 20, 2048
#: Two numbers of 32 bits share a long, random fields come first: the rows are many and move in less space.
ROWS = "key long, bits long, print_line long, doc long, n_place long"
CANDIDATES = "hub_doc long, hub_line int, doc long, line int, n int, kind int"
EVIDENCE = CANDIDATES + ", lists long"
STAR, PAIR, SAME = 1, 0, 2
LINKS = "doc long, line int, other_doc long, other_line int"
_names = lambda schema: [f.split()[0] for f in schema.split(", ")]


def dealt(keys: np.ndarray, expected: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row goes to which list: ``(row numbers, keys)``, rows of hot keys several times."""
    chunks = np.maximum(1, -(-expected // HOT)).astype(np.int64)
    rows = np.repeat(np.arange(len(keys)), chunks)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    g = chunks[rows]
    own = (mix(unit[rows]) % g.astype(U64)).astype(np.int64)
    cell = np.minimum(own, other) * g + np.maximum(own, other)
    return rows, list_key(np.where(g > 1, mix(keys[rows] + mix(cell.astype(U64) + U64(1))), keys[rows]))


def list_key(values: np.ndarray) -> np.ndarray:
    """44 bits name a list: enough to keep lists apart, and smaller to move."""
    return values >> U64(20)


def packed(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """Two columns of 32 bits in one."""
    return int64((high.astype(np.int64) << 32) | (low.astype(np.int64) & 0xFFFFFFFF))


def bit_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(U64)).astype(np.int64)


def order_by(*keys: np.ndarray) -> np.ndarray:
    """Places of the rows in the order of ``keys``, which are not negative, the first counting most; equal rows keep their order.

    Numpy sorts numbers several times faster than places.  So leading bits of the
    keys and the place share one number, and only rows that these bits do not
    tell apart are compared by the whole keys.
    """
    n = len(keys[0])
    width = n.bit_length()
    lead, free = np.zeros(n, U64), 64 - width
    for key in keys:
        bits = int(key.max(initial=0)).bit_length()
        taken = min(bits, free)
        if taken:
            lead = (lead << U64(taken)) | (key.astype(U64) >> U64(bits - taken))
            free -= taken
        if taken < bits:
            break
    lead = np.sort((lead << U64(width)) | np.arange(n, dtype=U64))
    order = (lead & U64((1 << width) - 1)).astype(np.int64)
    lead >>= U64(width)
    same = lead[1:] == lead[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if n else order
    rows = order[tied]
    order[tied] = rows[np.lexsort([key[rows] for key in keys[::-1]])]
    return order


def signature(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit map of the values of every row."""
    out = np.zeros(n, U64)
    np.bitwise_or.at(out, row, U64(1) << (mix(values) >> U64(58)))
    return out


def wide_signature(row: np.ndarray, values: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Bit maps of the values of every row, in four lines: a row has 1, 2 or 4 of them.

    Four maps fold to two (0 or 2, 1 or 3) and two to one, and what is folded
    equals the map of a row that never had more.
    """
    n = len(maps)
    drawn = mix(values)
    out = np.zeros(4 * n, U64)
    np.bitwise_or.at(out, ((drawn & U64(3)).astype(np.int64) % maps[row]) * n + row, U64(1) << (drawn >> U64(58)))
    return out.reshape(4, n)


class Part(dict):
    """Columns of some rows, taken as they are asked for."""

    def __init__(self, columns: dict, at: np.ndarray):
        super().__init__()
        self.columns, self.at = columns, at

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = taken = self.columns[name][self.at]
        return taken

    def of(self, which: np.ndarray) -> Part:
        return Part(self.columns, self.at[which])


def candidates(rows: DataFrame, near: Callable, star: Callable, ratio: tuple[int, int], shared: int | Column = 1) -> DataFrame:
    """Stars, pairs and equal units of all lists.

    ``near(a, b)`` and ``star(a, b)`` take two ``Part``s of arrays (n, place, bits)
    and tell which pairs may reach the threshold or belong to one star; ``rows``
    may have further columns for them.  With columns ``wide_1`` to ``wide_3``,
    ``bits`` is the first of four maps: it is called ``wide_0``, and ``bits`` is
    all four folded.
    ``ratio`` bounds the sizes: ``ratio[1] * smaller >= ratio[0] * larger``.
    Pairs outside stars have to meet in ``shared`` lists, which may depend on
    ``n``, the size of the later unit.
    """

    def lists(batches: Iterator[pa.RecordBatch]):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        c = {name: table.column(i).to_numpy() for i, name in enumerate(table.column_names)}
        del held, table
        for pair in ("print_line", "n_place"):
            high, low = pair.split("_")
            c[high], c[low] = (c[pair] >> 32).astype(np.int32), c[pair].astype(np.int32)
            del c[pair]

        if "wide_1" in c:
            c["wide_0"] = c["bits"]
            c["bits"] = c["wide_0"] | c["wide_1"] | c["wide_2"] | c["wide_3"]

        def take(which: np.ndarray) -> None:
            """One column after the other, so that only one is there twice."""
            for name in c:
                c[name] = c[name][which]

        def part(at: np.ndarray) -> Part:
            return Part(c, at)

        def out(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
            """``a`` the earlier unit; equal rows of several lists once."""
            if not len(a):
                key, count = np.zeros((5, 0), np.int64), np.zeros(0, np.int64)
            else:
                every = np.stack([c["doc"][a], c["line"][a], c["doc"][b], c["line"][b], c["n"][b]])
                every = every[:, np.lexsort(every[::-1])]
                at = np.flatnonzero(np.append(True, (every[:, 1:] != every[:, :-1]).any(axis=0)))
                key, count = every[:, at], np.diff(np.append(at, every.shape[1]))
            return pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1].astype(np.int32)), pa.array(key[2]), pa.array(key[3].astype(np.int32)),
                                               pa.array(key[4].astype(np.int32)), pa.array(np.full(key.shape[1], kind, np.int32)), pa.array(count)], names=_names(EVIDENCE))

        # Most of the sorting is by list; rows alone in theirs need no more of it.
        order = order_by(c["key"])
        key = c["key"][order]
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        met = np.bincount(group)[group] > 1
        order, group = order[met], group[met]
        if not len(order):
            return
        # Signed numbers in the order of unsigned ones.
        doc = c["doc"][order].view(U64) ^ (U64(1) << U64(63))
        place = order_by(group, c["n"][order], c["print"][order].view(np.uint32), c["bits"][order].view(U64), doc, c["line"][order])
        order = order[place]
        take(order)
        del order, place, doc, key, group, met

        def starts(*names: str) -> np.ndarray:
            new = np.append(True, c["key"][1:] != c["key"][:-1])
            for name in names:
                new[1:] |= c[name][1:] != c[name][:-1]
            return new

        # Equal units are told by the earliest of them.
        lead = starts("n", "print", "bits")
        first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        # They share all lists; that of their first value tells it.
        again = np.flatnonzero((c["place"] == 0) & ((c["doc"] != c["doc"][first]) | (c["line"] != c["line"][first])))
        yield out(first[again], again, SAME)
        take(lead)
        group = np.cumsum(starts()) - 1
        alone = np.bincount(group)[group] == 1
        if alone.all():
            return
        take(~alone)
        n = len(c["key"])
        group = np.cumsum(starts()) - 1
        # The hub: earliest (doc, line) of the list.
        every, begins = np.arange(n), np.flatnonzero(starts())
        earliest = c["doc"] == np.minimum.reduceat(c["doc"], begins)[group]
        line = np.where(earliest, c["line"], np.iinfo(np.int32).max)
        earliest &= line == np.minimum.reduceat(line, begins)[group]
        hub = np.minimum.reduceat(np.where(earliest, every, n), begins)[group]

        other = (c["doc"] != c["doc"][hub]) | (c["line"] != c["line"][hub])
        in_star = other & star(part(hub), part(every))
        yield out(hub[in_star], every[in_star], STAR)
        # The rest against all units of fitting size.
        compound = (group.astype(np.int64) << 32) | c["n"].astype(np.int64)
        loose = np.flatnonzero(other & ~in_star)
        lo = np.searchsorted(compound, (group[loose].astype(np.int64) << 32) | -(-c["n"][loose].astype(np.int64) * ratio[0] // ratio[1]), "left")
        hi = np.searchsorted(compound, (group[loose].astype(np.int64) << 32) | (c["n"][loose].astype(np.int64) * ratio[1] // ratio[0]), "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(loose):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            first = lo[at]
            if to == at + 1:
                spans = [(x, min(x + PAIRS_AT_ONCE, hi[at])) for x in range(first, hi[at], PAIRS_AT_ONCE)]
            else:
                spans = [None]
            for span in spans:
                if span is None:
                    count = (hi - lo)[at:to]
                    a = np.repeat(loose[at:to], count)
                    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at:to], count)
                else:
                    b = np.arange(*span)
                    a = np.full(len(b), loose[at])
                is_loose = other[b] & ~in_star[b]
                keep = (~is_loose | (b > a)) & (a != b) & ((c["doc"][a] != c["doc"][b]) | (c["line"][a] != c["line"][b]))
                a, b = a[keep], b[keep]
                ok = near(part(a), part(b))
                a, b = a[ok], b[ok]
                if len(a):
                    earlier = (c["doc"][a] < c["doc"][b]) | ((c["doc"][a] == c["doc"][b]) & (c["line"][a] < c["line"][b]))
                    yield out(np.where(earlier, a, b), np.where(earlier, b, a), PAIR)
            at = to

    met = rows.repartition("key").mapInArrow(lists, EVIDENCE).groupBy("hub_doc", "hub_line", "doc", "line").agg(
        F.max("n").alias("n"), F.max("kind").alias("kind"), F.sum("lists").alias("_lists"))
    return met.filter((F.col("kind") != PAIR) | (F.col("_lists") >= shared)).drop("_lists")


def _cells(found: DataFrame) -> DataFrame:
    """Members of every cell: ``(hub_doc, hub_line, i, j, doc, line, part)``; part -1 is the hub, else the chunk.

    A star of more than ``ELEMENTS`` set elements or ``CELL`` units is cut in
    chunks, each pair of chunks a cell.
    """
    hub = ["hub_doc", "hub_line"]
    sizes = found.groupBy(*hub).agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_e")).withColumn(
        "_g", F.greatest(F.ceil(F.col("_n") / CELL), F.ceil(F.col("_e") / ELEMENTS)).cast("int")).drop("_n", "_e")
    chunk = F.pmod(F.xxhash64("doc", "line"), F.col("_g")).cast("int")
    members = found.drop("n").join(sizes, hub).withColumn("part", chunk).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    pick = [*hub, F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "doc", "line", "part", "kind"]
    hubs = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("_g") - 1)))
    return members.select(*pick).unionByName(hubs.select(
        *hub, "i", "j", F.col("hub_doc").alias("doc"), F.col("hub_line").alias("line"), F.lit(-1).alias("part"), F.lit(STAR).alias("kind")))


def verified(found: DataFrame, units: DataFrame, key: list[str], sets: Callable, ratio: tuple[int, int], forest: bool = False,
             later: bool = False) -> DataFrame:
    """Links whose whole sets reach the threshold.

    With ``forest`` a cell gives no link between units that its other links
    connect: enough for components, and never more links than units.  With
    ``later`` it gives a unit no second link to an earlier unit (by ``doc`` and
    ``line``): enough to tell which have one, and never more links than units.

    ``units`` holds the text ``unit`` by ``key`` (``doc``, with ``line`` where
    units are lines); ``sets(block)`` gives the row and hash of all set elements
    of a block of units.  In a star, units linked to the hub need no other link;
    the others are compared with every unit of the cell.
    """
    order = ["hub_doc", "hub_line", "i", "j"]
    # Both sides grow with the input, so neither is broadcast where it happens to be small.
    cells = _cells(found).hint("merge").join(units, key).select(*order, "doc", "line", "part", "kind", "unit")

    def settle(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            last = table.slice(table.num_rows - 1, 1).select(order).to_pylist()[0]
            same = np.ones(table.num_rows, bool)
            for name in order:
                same &= table.column(name).to_numpy() == last[name]
            cut = int(np.flatnonzero(same)[0])
            if cut:
                yield _settled(table.slice(0, cut), order, sets, ratio, forest, later)
            held = table.slice(cut)
        if held is not None:
            yield _settled(held, order, sets, ratio, forest, later)

    sent = cells.repartition(*order).sortWithinPartitions(*order, "part")
    return sent.mapInArrow(settle, LINKS).dropDuplicates()


def _settled(table: pa.Table, order: list[str], sets: Callable, ratio: tuple[int, int], forest: bool, later: bool) -> pa.RecordBatch:
    """The links of whole cells, given in order."""
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in order])
    new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
    starts = np.append(np.flatnonzero(new), table.num_rows)
    part, kind = table.column("part").to_numpy(), table.column("kind").to_numpy()
    doc, line = table.column("doc").to_numpy(), table.column("line").to_numpy()
    crossing = keys[2] != keys[3]
    begins, values = [0], []
    for block in blocks(table.column("unit"), 4 << 20):
        row, value = sets(block)
        key = np.lexsort((value, row))
        row, value = row[key], value[key]
        fresh = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
        row, value = row[fresh], value[fresh]
        begins += (np.cumsum(np.bincount(row, minlength=block.n)) + begins[-1]).tolist()
        values.append(value)
    values = np.concatenate(values) if values else np.zeros(0, U64)
    begins = np.array(begins)
    sizes = np.diff(begins)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def against(one: int, lo: int, hi: int) -> np.ndarray:
        """Which of the rows ``lo`` to ``hi`` reach the threshold with row ``one``."""
        own = values[begins[one]:begins[one + 1]]
        if not len(own):
            return np.zeros(hi - lo, bool)
        theirs = values[begins[lo]:begins[hi]]
        spot = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        total = np.append(0, np.cumsum(own[spot] == theirs))
        common = total[begins[lo + 1:hi + 1] - begins[lo]] - total[begins[lo:hi] - begins[lo]]
        return (ratio[1] * common >= ratio[0] * (sizes[lo:hi] + len(own) - common)) & (common > 0)

    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        inside = part[lo:hi] >= 0
        if inside.all():
            continue
        hub = lo + int(np.flatnonzero(~inside)[0])
        linked = against(hub, lo, hi)
        # Every chunk has a cell of its own, which is where the hub's links are given.
        if not crossing[lo]:
            at = lo + np.flatnonzero(linked & inside)
            found.append((at, np.full(len(at), hub)))
        # Only stars compare among themselves.
        loose = lo + np.flatnonzero(~linked & inside & (kind[lo:hi] == STAR))
        # Units that links connect have one label.
        label = np.arange(lo, hi)
        label[linked] = hub
        # The hub is the earliest unit.
        told = linked.copy()
        for u in loose.tolist():
            close = against(u, lo, hi) & inside & (kind[lo:hi] == STAR)
            close[u - lo] = False
            if crossing[lo]:
                close &= part[lo:hi] != part[u]
            at = lo + np.flatnonzero(close)
            if forest:
                joined, first = np.unique(label[at - lo], return_index=True)
                at = at[first[joined != label[u - lo]]]
                label[np.isin(label, joined)] = label[u - lo]
            if later:
                before = close & ((doc[lo:hi] < doc[u]) | ((doc[lo:hi] == doc[u]) & (line[lo:hi] < line[u])))
                new = close & ~before & ~told
                if not told[u - lo] and before.any():
                    new[np.argmax(before)] = told[u - lo] = True
                told |= new & ~before
                at = lo + np.flatnonzero(new)
            found.append((at, np.full(len(at), u)))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([int64(doc[a]), pa.array(line[a].astype(np.int32)), int64(doc[b]), pa.array(line[b].astype(np.int32))],
                                      names=_names(LINKS))


def distinct_in_rows(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every row, sorted by row and value."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1])) if len(row) else np.zeros(0, bool)
    return row[fresh], values[fresh]


def row_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values per row, rows in order."""
    total = np.append(U64(0), np.cumsum(values, dtype=U64))
    ends = np.cumsum(np.bincount(row, minlength=n))
    return total[ends] - total[np.append(0, ends[:-1])]


class CountSketch:
    """How often values occur, at least: counts by hash bin, of fixed size for any input."""

    def __init__(self, bins: int):
        self.bins, self.slices = bins, max(1, bins >> 12)

    def bin_of(self, values: np.ndarray) -> np.ndarray:
        return (mix(values ^ U64(0x5851F42D4C957F2D)) % U64(self.bins)).astype(np.int64)

    def collect(self, df: DataFrame, values: Callable) -> np.ndarray:
        """Counts over all rows of ``df``; ``values(batch)`` yields arrays of values. ``bins`` numbers reach the driver."""
        bins, slices, bin_of = self.bins, self.slices, self.bin_of
        width = bins // slices
        schema = "slice int, counts binary"

        def rows(total):
            kept = [s for s in range(slices) if total[s * width:(s + 1) * width].any()]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([total[s * width:(s + 1) * width].tobytes() for s in kept], pa.binary())],
                                              names=["slice", "counts"])

        def count(batches):
            total = np.zeros(bins, np.int64)
            for batch in batches:
                for value in values(batch):
                    total += np.bincount(bin_of(value), minlength=bins)
            yield rows(total)

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.frombuffer(raw, np.int64)
                    total[s] = total[s] + own if s in total else own
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                                 names=["slice", "counts"])

        summed = df.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
        out = np.zeros(bins, np.int64)
        for s, raw in summed.collect():
            out[s * width:(s + 1) * width] += np.frombuffer(raw, np.int64)
        return out
