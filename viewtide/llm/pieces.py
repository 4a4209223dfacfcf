"""A SentencePiece BPE vocabulary as tables: pieces, merges, and its pre-tokens.

No piece of the vocabulary goes on after a space mark that follows other characters (checked when it is loaded), so a text
is cut at each run of space marks, and what one pre-token becomes doesn't depend on the others.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np

from .common import tokenizer_file

MARK = "▁"
_SLOT_BITS = 20
MODEL = "piece_bpe_32k.model"


class Vocabulary:
    """Pieces by id, ids by piece, and the merges of two ids; a smaller rank merges earlier."""

    def __init__(self, model: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.is_byte = np.zeros(n, bool)
        plain = {}
        for i, piece in enumerate(self.pieces):
            if p.is_byte(i):
                self.is_byte[i], self.byte_ids[int(piece[3:5], 16)] = True, i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                plain[piece] = i
                if MARK in piece.lstrip(MARK) or piece[:1] == MARK and piece[1:2] == MARK and piece.strip(MARK):
                    raise ValueError(f"{model}: a piece goes across a space mark")
        self.ids = plain
        self.chars = {c: i for c, i in plain.items() if len(c) == 1}
        by_score = sorted(plain.values(), key=lambda i: (-p.get_score(i), i))
        self.rank = np.full(n, n, np.int32)
        self.rank[by_score] = np.arange(len(by_score))
        #: What decoding writes for each piece.
        self.bytes = [bytes([int(x[3:5], 16)]) if self.is_byte[i] else x.replace(MARK, " ").encode() for i, x in enumerate(self.pieces)]

        #: Every way to put a piece together from two, by the key left * n + right, and a hash table over the keys.
        found = sorted((plain[x[:k]] * n + plain[x[k:]], i) for x, i in plain.items() for k in range(1, len(x)) if x[:k] in plain and x[k:] in plain)
        self.merge_keys, self.merge_ids = (np.array(c, np.int64) for c in zip(*found, strict=True))
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        at = self._slot(self.merge_keys)
        self.slots[at] = np.arange(len(at))
        #: Slots that several keys want; those keys are looked up in order.
        self.shared = np.zeros(1 << _SLOT_BITS, bool)
        used, times = np.unique(at, return_counts=True)
        self.shared[used[times > 1]] = True
        #: The smallest of 16 and 32 bits that holds an id.
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        #: Ids of single characters by code point.
        self.char_ids = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.char_ids[ord(c)] = i

    @property
    def n(self) -> int:
        return len(self.pieces)

    @cache  # noqa: B019  vocabularies are few and stay
    def merges(self) -> dict[int, tuple[int, int]]:
        """merge() of single pairs, by left * n + right: (rank, merged id)."""
        return dict(zip(self.merge_keys.tolist(), zip(self.rank[self.merge_ids].tolist(), self.merge_ids.tolist(), strict=True), strict=True))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair of ids; rank is n where they don't merge."""
        key = left.astype(np.int64) * self.n + right
        slot = self._slot(key)
        at = self.slots[slot]
        hit = self.merge_keys[at] == key
        again = np.flatnonzero(~hit & self.shared[slot])
        if len(again):
            at[again] = np.minimum(np.searchsorted(self.merge_keys, key[again]), len(self.merge_keys) - 1)
            hit[again] = self.merge_keys[at[again]] == key[again]
        hit &= (left >= 0) & (right >= 0)
        ids = np.where(hit, self.merge_ids[at], 0).astype(np.int32)
        return np.where(hit, self.rank[ids], np.int32(self.n)), ids


@lru_cache(maxsize=2)
def vocabulary(model: str = MODEL) -> Vocabulary:
    return Vocabulary(model)

