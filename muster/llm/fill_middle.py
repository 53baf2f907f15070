"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

Texts are cut at lines or at characters, chosen by a seeded hash of the
document id, and rearranged so that the middle comes last.  Lines are found as
bytes, lengths are told in code points, characters are chosen as code points
and cut as bytes.  Instead of an offset per character, an ``Exceptions`` index
records only the multibyte characters of a block of texts: their positions and
the bytes they have beyond the first.  A binary search gives the excess before
a cut; within ASCII spans the conversion is a subtraction.

Only cuts come back from Python: texts are sliced, joined and rebuilt by Spark
on their bytes.  No shuffle, one pass, one block of texts in memory at a time.

Defined results: null text is empty text; empty texts and texts that hold a
marker stay plain; a null id hashes as the empty string; rows are independent,
so repeated rows give repeated results and ties cannot arise; a very long text
is a block of its own and takes about 25 bytes of index per multibyte
character; an empty table gives no rows.  Only the two named columns are read,
so further columns may have any names and are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from muster.llm.words import Block, blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percentage of documents that are rearranged, and of those in suffix-first form.
FIM_RATE, SPM_RATE = 100, 50
UNITS = ("line", "char")
_CUTS = "n long, prefix_bytes long, middle_end long, prefix_chars long, middle_chars long"


class Exceptions:
    """Where a UTF-8 byte sequence departs from one byte per character."""

    def __init__(self, data: np.ndarray):
        #: Byte position of every multibyte character.
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: Excess bytes before the k-th of them, and in all.
        self.before = np.concatenate([[0], np.cumsum(excess)]).astype(np.int64)
        self.char_at = self.at - self.before[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position (a character boundary)."""
        return byte - self.before[np.searchsorted(self.at, byte, "left")]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each code point position."""
        return char + self.before[np.searchsorted(self.char_at, char, "left")]


def _line_cuts(block: Block, picks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lines per row and, for each pick, the byte where the unit of number ``pick % (n + 1)`` starts."""
    lo, hi = block.offsets[:-1], block.offsets[1:]
    feeds = np.flatnonzero(block.data == 0x0A) + 1
    # A row that does not end in a line feed ends its last line itself.
    open_ = (hi > lo) & (block.data[np.maximum(hi, 1) - 1] != 0x0A) if len(block.data) else np.zeros(len(lo), bool)
    ends = np.sort(np.concatenate([feeds, hi[open_]]))
    first = np.searchsorted(ends, lo, "right")
    n = np.searchsorted(ends, hi, "right") - first
    ends = np.append(ends, 0)
    cuts = []
    for pick in picks:
        k = pick % (n + 1)
        cuts.append(np.where(k > 0, ends[np.minimum(first + k - 1, len(ends) - 1)], lo))
    return n, cuts


def _char_cuts(block: Block, index: Exceptions, picks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    starts = index.chars(block.offsets)
    n = np.diff(starts)
    return n, [index.bytes(starts[:-1] + pick % (n + 1)) for pick in picks]


def cuts_of(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str) -> pa.StructArray:
    """Units, byte cuts and code-point lengths of every text."""
    out = [np.zeros(len(texts), np.int64) for _ in range(5)]
    for block in blocks(texts):
        rows = slice(block.first, block.first + block.n)
        index = Exceptions(block.data)
        picks = [h1[rows], h2[rows]]
        n, (a, b) = _line_cuts(block, picks) if unit == "line" else _char_cuts(block, index, picks)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        start, begin, end = index.chars(block.offsets[:-1]), index.chars(lo), index.chars(hi)
        for column, values in zip(out, (n, lo - block.offsets[:-1], hi - block.offsets[:-1], begin - start, end - begin)):
            column[rows] = values
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "prefix_bytes", "middle_end", "prefix_chars", "middle_chars"])


def _cuts(unit: str):
    @F.arrow_udf(_CUTS)
    def find(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return cuts_of(text, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), unit)

    return find


def _group(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", seed: int = SEED,
                   fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``(<id>, n, form, prefix_chars, middle_chars, output)`` per row.

    ``n`` counts the units of the text, ``form`` is ``plain``, ``psm`` or
    ``spm``; the lengths are null where it is plain.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")))
    rows = documents.select(F.col(f"`{id}`").alias("id"), body.alias("text"), F.sha2(F.encode(key, "UTF-8"), 256).alias("digest"))
    rows = rows.select("id", "text", *[_group("digest", k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("cut", _cuts(unit)("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= fim_rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    data = F.col("text").cast("binary")
    start, end = F.col("cut.prefix_bytes").cast("int"), F.col("cut.middle_end").cast("int")
    prefix, middle = F.substring(data, F.lit(1), start), F.substring(data, start + 1, end - start)
    suffix = F.substring(data, end + 1, F.octet_length("text"))
    mark = {name: F.lit(bytearray(name.encode())) for name in (PREFIX, SUFFIX, MIDDLE)}
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm.cast("string")).otherwise(psm.cast("string"))
    shown = lambda c: F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c)
    return rows.withColumn("form", form).select(
        F.col("id").alias(id), F.col("cut.n").alias("n"), "form", shown("prefix_chars"), shown("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output, from the output and its form alone.

    A rearranged text holds no marker of its own, and no marker overlaps
    another, so the output splits at exactly its three markers.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(documents: DataFrame, **options) -> DataFrame:
    """Forms, lengths and SHA-256 digests of the outputs and of the texts rebuilt from them."""
    made = fill_in_middle(documents, **options)
    hashed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(*[c for c in made.columns if c != "output"], hashed(F.col("output")).alias("output_sha256"),
                       hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
