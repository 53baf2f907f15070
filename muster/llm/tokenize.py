"""Token ids of whole texts for a word-level BPE vocabulary, fast on repeated words.

The vocabulary's pre-tokenizer never joins text across white space, nor across
a border between ASCII letters, digits and punctuation (apostrophes and
non-ASCII bytes aside), so texts are cut there with numpy, every distinct piece
is encoded once by the tokenizer, and ids are put together from a table of
pieces.  The table lives in the Python worker, only saves time, and is emptied
when it holds ``TABLE_PIECES`` pieces; it is arrays sorted by hash, about 40
bytes a piece.  Texts that hold one of the vocabulary's
special strings are encoded whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from muster.llm.words import LOWER, Block, byte_hashes

TABLE_PIECES = 2_000_000
_kind = np.full(256, 5, np.uint8)
_kind[[0x20, *range(0x09, 0x0E)]] = 0
_kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_kind[0x30:0x3A] = 2
_kind[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = 3
_cuttable = np.zeros((6, 6), bool)
_cuttable[1:4, 1:4] = ~np.eye(3, dtype=bool)
_cuttable[2, 2] = True
_made: dict = {}


class WordTokens:
    """Encoder with its table of pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.end, self.ids = 0, np.zeros(1 << 14, np.uint32)

    def encode_one(self, text: str) -> list[int]:
        if text.isalpha() and text.lower() == text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else self.bytes.pre_tokenize_str(text)[0][0])]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand in the table or would, and whether they are there."""
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        return place, known

    def _learn(self, place: np.ndarray, keys: np.ndarray, texts: list[str]) -> None:
        """Encode pieces and enter them before the given places; ``keys`` are in order."""
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        for k, text in enumerate(texts):
            ids = self.encode_one(text)
            while self.end + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            begin[k], size[k] = self.end, len(ids)
            self.ids[self.end:self.end + len(ids)] = ids
            self.end += len(ids)
        self.keys, self.begin, self.size = (np.insert(old, place, new) for old, new in ((self.keys, keys), (self.begin, begin), (self.size, size)))

    def pieces(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = LOWER[block.data]
        kind = _kind[block.data]
        mark = kind > 0
        begin, end = mark.copy(), mark.copy()
        cut = _cuttable[kind[:-1], kind[1:]] | ~(mark[:-1] & mark[1:])
        begin[1:] &= cut
        end[:-1] &= cut
        lo, hi = block.offsets[:-1], block.offsets[1:]
        full = hi > lo
        begin[lo[full]] = mark[lo[full]]
        end[hi[full] - 1] = mark[hi[full] - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return data, starts, ends, np.searchsorted(block.offsets, starts, "right") - 1, byte_hashes(data, starts, ends)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a line, and how many each row has."""
        if len(self.keys) > TABLE_PIECES:
            self.clear()
        data, starts, ends, row, key = self.pieces(block)
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        place, known = self._places(unique)
        new = np.flatnonzero(~known)
        if len(new):
            at = first[new]
            raw = data.tobytes()
            self._learn(place[new], unique[new], [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            place, _ = self._places(unique)
        place = place[back]
        size = self.size[place].astype(np.int64)
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[place] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        counts = np.bincount(row, size, block.n).astype(np.int64)
        lowered = data.tobytes()
        if any(s in lowered for s in self.special):
            ids, counts = self._whole(block, lowered, ids, counts)
        return ids, counts

    def _whole(self, block: Block, lowered: bytes, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the rows that hold a special string encoded whole."""
        parts, ends = [], np.cumsum(counts)
        for r in range(block.n):
            lo, hi = int(block.offsets[r]), int(block.offsets[r + 1])
            own = ids[ends[r] - counts[r]:ends[r]]
            if any(lowered.find(s, lo, hi) >= 0 for s in self.special):
                own = np.array(self.tokenizer.encode(block.text(lo, hi), add_special_tokens=False).ids, np.uint32)
            parts.append(own)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def encoder(path: str) -> WordTokens:
    """The encoder of this Python worker."""
    if path not in _made:
        _made[path] = WordTokens(path)
    return _made[path]
