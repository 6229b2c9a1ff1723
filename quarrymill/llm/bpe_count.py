"""Operator 3: token counts by heap-and-linked-list byte-pair merging (``count_tokens``).

A byte-level BPE word starts as one symbol per byte; merges always take the lowest-rank adjacent pair, found with a
heap over a doubly linked list, so the count is symbols minus merges and no identifier is ever made.

Texts are cut into the vocabulary's own pre-tokens. Most cuts come from a cheaper rule first: a single space between
two characters that are not white space always starts a pre-token, so pieces between such spaces can be counted apart
and remembered per Python worker (a memo of bounded size). Texts where a space touches other white space, or that
hold a special string, take the full pattern.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is one token; very long
texts are counted whole; repeated rows give one row each; an empty table gives an empty result; only id and text columns
are read, others may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries a worker's memo holds before its older half is dropped.
MEMO_ENTRIES = 1_000_000
#: What is returned for a piece that the cheap cut can't take; more than any sum of counts.
_UNSAFE = -(1 << 50)


def merge_count(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """The number of merges that byte-pair encoding makes in one pre-token.

    ``ranks`` has the rank of a pair under ``left << 20 | right``, ``made`` the symbol that a rank's merge makes.
    A heap entry is ``rank << 32 | position``; ``pair[position]`` is the rank that is in force there.
    """
    n = len(symbols)
    look = ranks.get
    pair = [look(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
    heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
    if not heap:
        return 0
    pair.append(-1)
    heapify(heap)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    merges = 0
    while heap:
        entry = heappop(heap)
        left, rank = entry & 0xFFFFFFFF, entry >> 32
        if pair[left] != rank:
            continue  # the pair has gone since it was pushed
        merges += 1
        right = after[left]
        symbol = symbols[left] = made[rank]
        pair[right] = -1
        following = after[left] = after[right]
        if following >= 0:
            before[following] = left
            r = pair[left] = look(symbol << 20 | symbols[following], -1)
            if r >= 0:
                heappush(heap, r << 32 | left)
        else:
            pair[left] = -1
        previous = before[left]
        if previous >= 0:
            r = pair[previous] = look(symbols[previous] << 20 | symbol, -1)
            if r >= 0:
                heappush(heap, r << 32 | previous)
    return merges


class Memo(dict):
    """key -> value by ``make``, of bounded size: of two generations the older one is dropped when the newer is full."""

    def __init__(self, make, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.limit, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TokenCounter:
    """Counts the tokens of a byte-level BPE vocabulary given as a tokenizers JSON file."""

    def __init__(self, vocabulary: str, memo_entries: int = MEMO_ENTRIES):
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        number = {s: i for i, s in enumerate(dict.fromkeys([*self._byte_symbols(), *(a + b for a, b in merges)]))}
        self.ranks = {number[a] << 20 | number[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [number[a + b] for a, b in merges]
        self.byte_symbol = [number[s] for s in self._byte_symbols()]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # The pre-token pattern of byte-level BPE.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.words = Memo(self._word, memo_entries)
        self.pieces = Memo(self._piece, memo_entries // 2)

    @staticmethod
    def _byte_symbols() -> list[str]:
        """Byte-level BPE writes printable Latin-1 bytes as themselves and the others as code points from 256 on."""
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(others)) for b in range(256)]

    def _word(self, word: str) -> int:
        symbols = [self.byte_symbol[b] for b in word.encode()]
        return len(symbols) - merge_count(symbols, self.ranks, self.made)

    def _piece(self, piece: str) -> int:
        return _UNSAFE if not piece or piece[0].isspace() or piece[-1].isspace() else self._plain(" " + piece)

    def _plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.pattern.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special and any(s in text for s in self.special):
            return len(self.split_special.findall(text)) + sum(map(self.count, self.split_special.split(text)))
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            total = sum(map(self.pieces.__getitem__, rest))
            if total >= 0:
                return self._plain(first) + total
        return self._plain(text)


@lru_cache(maxsize=2)
def _counter(vocabulary: str, memo_entries: int) -> TokenCounter:
    return TokenCounter(vocabulary, memo_entries)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row; ``vocabulary`` defaults to the 50k byte-level file."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        counter = _counter(path, memo_entries)
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = [0 if t is None else len(t.encode()) for t in texts]
            counts = list(map(counter.count, texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
