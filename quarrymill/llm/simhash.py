"""Operator 7: SimHash near-duplicates by Golay-code fuzzy hashing (``fingerprints``, ``near_duplicate_groups``).

A fingerprint is cut into segments of 22, 21 and 21 bits. Where two fingerprints differ in at most two bits, at least
one segment is equal and the next one differs in at most two bits, so the pair shares a key made of the equal
segment and one of the next segment's one or six nearby Golay codewords. Equal fingerprints are one node. Nodes that
share a key are compared bit by bit; keys with more than ``PAIR_NODES`` nodes are not paired but solved exactly
through neighbours: two fingerprints differ in at most two bits just when they share one that is at most one bit from
each, and no more than 65 fingerprints lie so close to one.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; very long texts are read whole; a bit that exactly half of
the shingles set is zero; extra columns may have any name; rows with equal ids
each give a row; a component of null ids alone has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .golay import near_codewords

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more nodes than this are solved through neighbours instead of pairs.
PAIR_NODES = 24


def _shingles(text: str, n: int) -> list[bytes]:
    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at the contract's white space only
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    joined = b" ".join(words)
    return [joined[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist())]


def text_fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes."""
    import xxhash

    grams = _shingles(text, n) if text else []
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """``(id, text_hash, fp)``: one row per document, the 64 bits as a signed long."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((text_fingerprint(t.as_py(), n, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` pairs: up to eighteen keys for each fingerprint."""
    bits = fp.view(np.uint64)
    parts = [(bits >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        index, count = near_codewords(parts[(i + 1) % len(parts)])
        row, col = np.nonzero(np.arange(6) < count[:, None])
        rows.append(row)
        keys.append(i << 34 | exact[row] << 12 | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.asarray(b.column(0))
        row, key = fuzzy_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for b in batches:
        fp = np.asarray(b.column(0))
        near = (fp.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fp, 65))], ["near", "fp"])


def fingerprint_links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """``nodes`` (fp, distinct) to links ``(u, v)`` that join all fingerprints within two bits of each other."""
    if max_bits > 2:
        raise ValueError("the keys hold for up to two differing bits")
    keyed = written(nodes.select("fp").mapInArrow(_keyed, "key long, fp long"), "keyed")
    shared = keyed.join(keyed.groupBy("key").count().filter("count > 1"), "key")
    pairs = (
        shared.filter(F.col("count") <= PAIR_NODES)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.explode("fps").alias("u"), "fps")
        .select("u", F.explode(F.filter("fps", lambda v: (v > F.col("u")) & (F.bit_count(v.bitwiseXOR(F.col("u"))) <= max_bits))).alias("v"))
    )
    hot = shared.filter(F.col("count") > PAIR_NODES).select("fp").distinct()
    between = (
        hot.mapInArrow(_neighbours, "near long, fp long")
        .groupBy("near")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most 65
        .filter(F.size("fps") > 1)
        .select(F.element_at("fps", 1).alias("u"), F.explode(F.slice("fps", 2, 65)).alias("v"))
    )
    if max_bits < 2:
        between = between.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return pairs.union(between).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed: int = 42) -> DataFrame:
    """``(id, text_hash, fp, component_id)``, a row per document; component_id is the smallest id that links reach."""
    prints = written(fingerprints(docs, id_col, text_col, n, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = connected_components(fingerprint_links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = written(rooted.join(lowest, "root").select("fp", "component_id"), "classes")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each of ``groups`` (of these documents) the row whose id is the group's.

    Where several rows have that id, the one with the smallest text hash stays, and one of equal rows. Of a group of
    null ids alone, one row stays. Columns of ``docs`` may have any names.
    """
    groups = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    # Null ids have no component of their own: their fingerprint tells the groups apart.
    apart = F.when(F.col(id_col).isNull(), F.col("fp"))
    chosen = written(groups.groupBy(F.col(id_col).alias("id"), apart.alias("apart")).agg(F.min("text_hash").alias("hash"), F.count("*").alias("n")), "chosen")
    marked = docs.select(F.struct("*").alias("row"), docs[id_col].alias("own_id"), F.xxhash64(docs[text_col]).alias("own"))
    kept = marked.join(chosen, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")))
    once = kept.filter("n = 1").select("row")
    if not chosen.filter("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("own_id", "own").orderBy(F.lit(1)))
        once = once.union(kept.filter("n > 1").withColumn("place", place).filter("place = 1").select("row"))
    return once.select("row.*")
