"""Static range asymmetric numeral system over token ids, many streams in lockstep with numpy.

One table of frequencies (summing to 2^18) is shared by all blocks. A document's ids are cut into independent blocks of
at most 2048; a block's ids are dealt in turn to four interleaved states of 64 bits that emit 32-bit words, and within
a row of four ids the words lie in lane order, so that a decoder moves through them once. Each block has a checkpoint:
its states and the place of its first word. All blocks of a batch are coded together, and any block alone can be.
"""

from __future__ import annotations

import numpy as np

PRECISION = 18
LANES = 4
#: Rows of LANES ids in a block.
BLOCK_ROWS = 512
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_LOW_WORD = np.uint64(0xFFFFFFFF)
_U = np.uint64


def table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^PRECISION, at least one for each id that occurs."""
    counts = np.asarray(counts, np.float64)
    seen = counts > 0
    room = (1 << PRECISION) - int(seen.sum())
    if room < 0:
        raise ValueError("more ids than the table has places")
    if not seen.any():
        return np.zeros(len(counts), np.int64)
    share = counts / counts.sum() * room
    freq = np.floor(share).astype(np.int64)
    rest = np.lexsort((np.arange(len(counts)), -(share - freq)))[: room - int(freq.sum())]
    freq[rest] += 1  # largest remainders first, then lower ids; only ids that occur have a remainder
    if (short := room - int(freq.sum())) > 0:
        freq[int(np.argmax(counts))] += short
    return freq + seen


class Coder:
    """Encodes and decodes batches of documents with one frequency table."""

    def __init__(self, freq: np.ndarray):
        freq = np.asarray(freq, np.int64)
        # Frequency above and cumulative frequency below in one word: one look-up gives both.
        self.packed = freq.astype(np.uint64) << _WORD | (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
        self.pad = int(np.argmax(freq)) if len(freq) else 0

    @staticmethod
    def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents cut into blocks: ``(document, rows, first row, order by falling rows)`` of every block."""
        rows = -(-sizes // LANES)
        blocks = -(-rows // BLOCK_ROWS)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(BLOCK_ROWS, rows[doc] - nth * BLOCK_ROWS)
        first = (np.cumsum(rows) - rows)[doc] + nth * BLOCK_ROWS
        return doc, length, first, np.argsort(-length, kind="stable")

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, bytes]]:
        """``(words, marks)`` of each document; ``ids`` has the documents' ids one after another, ``sizes`` how many.

        ``marks`` has the checkpoint of each block: its four states and the number of its first word, as five
        unsigned longs.
        """
        sizes = np.asarray(sizes, np.int64)
        rows = -(-sizes // LANES)
        padded = np.full(int(rows.sum()) * LANES, self.pad, self.symbol.dtype)
        shift = (np.cumsum(rows) - rows) * LANES - (np.cumsum(sizes) - sizes)
        padded[np.repeat(shift, sizes) + np.arange(len(ids))] = ids
        doc, length, first, order = self._blocks(sizes)
        by_length = length[order]
        base = first[order] * LANES
        words = np.zeros(len(padded), np.uint32)
        end = base + by_length * LANES  # words fill each block's own range from its end
        at = end.copy()
        state = np.full((len(doc), LANES), _LOW, np.uint64)
        lanes = np.arange(LANES)
        top = int(by_length[0]) if len(doc) else 0
        active = np.searchsorted(-by_length, -np.arange(top), side="left")  # blocks with more rows than r
        for r in range(top - 1, -1, -1):
            k = int(active[r])
            s = padded[(base[:k] + r * LANES)[:, None] + lanes]
            both, x = self.packed.take(s), state[:k]
            f = both >> _WORD
            full = x >= f << _U(63 - PRECISION)
            rank = full.cumsum(axis=1, dtype=np.int64)
            at[:k] -= rank[:, -1]
            put = np.flatnonzero(full)
            flat = x.reshape(-1)  # a view: the states of the first k blocks lie together
            moved = flat[put]
            words[(rank + (at[:k, None] - 1)).reshape(-1)[put]] = moved & _LOW_WORD
            flat[put] = moved >> _WORD
            q = x // f
            state[:k] = (q << _U(PRECISION)) + (x - q * f) + (both & _LOW_WORD)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        at, end, state = at[back], end[back], state[back]  # in the documents' order again
        parts: list[list[bytes]] = [[] for _ in sizes]
        for d, a, e in zip(doc.tolist(), at.tolist(), end.tolist()):
            parts[d].append(words[a:e].tobytes())
        held = np.cumsum(end - at) - (end - at)
        heads = np.searchsorted(doc, np.arange(len(sizes)))
        marks = np.column_stack((state, (held - held[heads[doc]] if len(doc) else held).astype(np.uint64)))
        tails = np.append(heads, len(doc))
        return [(b"".join(p), marks[tails[i] : tails[i + 1]].tobytes()) for i, p in enumerate(parts)]

    def decode(self, blocks: list[tuple[bytes, bytes]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, starts)``: the documents' ids; document i has ``sizes[i]`` of them from ``starts[i]`` on."""
        sizes = np.asarray(sizes, np.int64)
        rows = -(-sizes // LANES)
        words = np.frombuffer(b"".join(w for w, _ in blocks) + bytes(4), np.uint32).astype(np.uint64)
        start = np.cumsum([0, *(len(w) // 4 for w, _ in blocks)])[:-1]
        marks = np.frombuffer(b"".join(m for _, m in blocks), np.uint64).reshape(-1, LANES + 1)
        doc, length, first, order = self._blocks(sizes)
        doc, length, to = doc[order], length[order], first[order] * LANES
        state = marks[order, :LANES].copy()
        at = start[doc] + marks[order, LANES].astype(np.int64)
        out = np.zeros(int(rows.sum()) * LANES, self.symbol.dtype)
        lanes = np.arange(LANES)
        mask = _U((1 << PRECISION) - 1)
        top = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(top), side="left")
        for r in range(top):
            k = int(active[r])
            x = state[:k]
            slot = x & mask
            s = self.symbol.take(slot.view(np.int64))
            out[(to[:k] + r * LANES)[:, None] + lanes] = s
            both = self.packed.take(s)
            x = (both >> _WORD) * (x >> _U(PRECISION)) + slot - (both & _LOW_WORD)
            low = x < _LOW
            rank = low.cumsum(axis=1, dtype=np.int64)
            get = np.flatnonzero(low)
            flat = x.reshape(-1)
            flat[get] = flat[get] << _WORD | words[(rank + (at[:k, None] - 1)).reshape(-1)[get]]
            at[:k] += rank[:, -1]
            state[:k] = x
        return out, (np.cumsum(rows) - rows) * LANES
