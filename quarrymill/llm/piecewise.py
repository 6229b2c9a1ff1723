"""Operator 11: context-triggered piecewise hashing (``fingerprints``, ``compared``, ``next_likeness``).

A rolling hash over seven bytes decides where a text is cut: after every byte whose hash is under ``2^32 / block size``, so
that the cuts follow the text wherever a passage stands. A chunk gives two base64 characters of its checksum. The block
size is the smallest power of two, from ``MIN_BLOCK`` up, that cuts at most ``MAX_CUTS`` times; the fingerprint has the
chunk signatures of that block size, of twice and of four times it. Two fingerprints are compared at the smallest block
size that both have: the likeness is 1 less the edit distance (insertions and deletions) over both signatures' chunks.

Defined results: a null, empty text has no chunks; a fingerprint is like its equal by 1, one without chunks is like any
other by 0, and so are two that share no block size; very long texts are read whole, in slices of ``_SLICE`` bytes;
lone surrogates don't occur in Spark strings; rows with equal ids are neighbours in the order of their texts' hashes, equal
rows of each other; null ids come first; a single row is its own next one; an empty table gives no rows; only id and text
columns are read, further columns may have any name.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_BLOCK, MAX_CUTS, SIGNATURES, REACH = 4, 64, 3, 7
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SLICE = 1 << 16
_FACTOR = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A mixed 32-bit number for each byte."""
    x = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0xC2B2AE35)
    return x ^ x >> np.uint32(13)


@lru_cache(maxsize=1)
def _symbols() -> list[str]:
    return [a + b for a in _BASE64 for b in _BASE64]


def rolling(data: bytes) -> np.ndarray:
    """The hash of the seven bytes that end at each byte; before the start there are none."""
    value = _byte_values()[np.frombuffer(data, np.uint8)]
    out = value.copy()
    for back in range(1, min(REACH, len(value))):
        value *= _FACTOR
        out[back:] += value[:-back]
    return out ^ out >> np.uint32(16)


def _low_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the bytes that can be cuts: those with the lowest hashes, more than ``MAX_CUTS`` if there are."""
    limit = (1 << 32) // MIN_BLOCK
    # About eight times as many as are needed; all of the smallest block size if these turn out too few.
    for top in (min(limit, (8 * MAX_CUTS << 32) // max(1, len(data))), limit):
        places, hashes = [], []
        for start in range(0, len(data), _SLICE):
            ahead = min(start, REACH - 1)
            own = rolling(data[start - ahead : start + _SLICE])[ahead:]
            at = np.flatnonzero(own < top)
            places.append(at + start)
            hashes.append(own[at])
        places, hashes = np.concatenate(places), np.concatenate(hashes)
        if len(places) > MAX_CUTS or top == limit:
            return places, hashes


def block_size(hashes: np.ndarray) -> int:
    """The smallest block size under which at most ``MAX_CUTS`` of the hashes are cuts."""
    if len(hashes) <= MAX_CUTS:
        return MIN_BLOCK
    # The first hash too many: cuts are those under 2^32 / size, and that must not reach it.
    first_over = int(np.partition(hashes, MAX_CUTS)[MAX_CUTS])
    size = MIN_BLOCK
    while size < 1 << 32 and first_over < (1 << 32) // size:
        size *= 2
    return size


def fingerprint(text: str | None) -> str:
    """``block size:signature:signature:signature``."""
    data = (text or "").encode()
    if not data:
        return f"{MIN_BLOCK}" + ":" * SIGNATURES
    places, hashes = _low_places(data)
    size = block_size(hashes)
    out, symbols, view = [str(size)], _symbols(), memoryview(data)
    for k in range(SIGNATURES):
        ends = (places[hashes < (1 << 32) // (size << k)] + 1).tolist()
        if not ends or ends[-1] < len(data):
            ends.append(len(data))
        out.append("".join(symbols[binascii.crc32(view[a:b]) & 4095] for a, b in zip([0, *ends], ends)))
    return ":".join(out)


def common_chunks(a: list[str], b: list[str]) -> int:
    """The longest common subsequence, by one whole number whose bits are the places of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = open_places = (1 << len(a)) - 1
    for c in b:
        met = open_places & masks.get(c, 0)
        open_places = (open_places + met | open_places - met) & full
    return len(a) - open_places.bit_count()


def likeness(one: str, other: str) -> float:
    """1 less the edit distance of the chunks over their number, at the smallest block size of both; 0 if there is none."""
    if one == other:
        return 1.0
    (size_a, *sigs_a), (size_b, *sigs_b) = one.split(":"), other.split(":")
    by_size = {int(size_b) << k: s for k, s in enumerate(sigs_b)}
    for k, a in enumerate(sigs_a):
        b = by_size.get(int(size_a) << k)
        if b is not None:
            chunks = [[s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b)]
            total = len(chunks[0]) + len(chunks[1])
            return 2 * common_chunks(*chunks) / total if total else 0.0
    return 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``, a row per document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], [id_col, "fingerprint"])

    own = docs.select(docs[id_col], docs[text_col].alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, fingerprint string")


def compared(pairs: DataFrame, one: str, other: str, into: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints."""

    @F.pandas_udf("double")
    def of(a, b):
        import pandas as pd

        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn(into, of(one, other))


_ROW = "n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"


def half_replaced(text: str, following: str) -> str:
    """The text with its last ``len // 2`` code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _measured(text: str, own: str, following: str, next_fingerprint: str) -> tuple:
    edited = half_replaced(text, following)
    other = fingerprint(edited)
    return len(text), own, hashlib.sha256(edited.encode()).hexdigest(), other, likeness(own, other), likeness(own, next_fingerprint)


def _neighbours(id_type: pa.DataType):
    """Sorted rows to one row each, measured against the next; the first and last row of a partition are given as edges."""
    names = ["edge", "id", "text", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.string(), id_type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                own = fingerprint(text)
                if last is None:
                    out.append(("first", key, text, None, own, None, None, None, None))
                else:
                    out.append((None, last[0], None, *_measured(last[1], last[2], text, own)))
                last = key, text, own
            yield made(out)
        if last is not None:
            yield made([("last", last[0], last[1], None, last[2], None, None, None, None)])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_measured(*x) for x in zip(*(c.to_pylist() for c in b.columns[1:]))]
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", *(x.split()[0] for x in _ROW.split(", "))])


def next_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next)``: every text against an edited one and the next one.

    The next document is the one with the next higher id, after the last the first; the edited text ends in its beginning
    (``half_replaced``). Documents are dealt out by ranges of ids and read in order; only a range's first and last text
    are kept, to be joined with those of the ranges beside it.
    """
    id_type = docs.schema[id_col].dataType
    keys = ["id", "text_hash", "read_at"]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash")).withColumn("read_at", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    arrow_id = pa.int64() if id_type.simpleString() == "bigint" else pa.int32() if id_type.simpleString() == "int" else pa.string()
    ranged = dealt.mapInArrow(_neighbours(arrow_id), f"edge string, id {id_type.simpleString()}, text string, {_ROW}")
    held = written(ranged.withColumn("part", F.spark_partition_id()), "neighbours")

    first = held.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("next_fingerprint"))
    # One number per range: which range with rows comes next.
    parts = held.filter("edge = 'last'").select("part")
    turn = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    last = held.filter("edge = 'last'").select("part", "id", "text", "fingerprint").join(turn, "part").join(first, "next_part")
    ends = last.select("id", "text", "fingerprint", "following", "next_fingerprint").mapInArrow(_edges, f"id {id_type.simpleString()}, {_ROW}")
    return held.filter("edge IS NULL").select("id", *(x.split()[0] for x in _ROW.split(", "))).union(ends).withColumnRenamed("id", id_col)
