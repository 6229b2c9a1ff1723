"""Near copies: documents whose five-word shingles are alike by 0.8 or more (``near_copy_groups``), by SimHash and Golay keys.

A document's set of shingles gives a SimHash of ``WORDS`` 64-bit words and ``SEGMENTS`` min-hashes. Segments of 23 bits are
decoded to the indices of their nearby Golay codewords; a key is one such index of a segment together with the segment's
min-hash. Two documents at 0.8 have a min-hash in common with a probability of 0.8 and an index with 0.6, so that they
share one of eight keys with 0.995, closer ones with more. Documents without a common shingle share no min-hash, so that
keys don't meet by chance however many documents there are.

Documents with equal sets are one node. Every key's nodes are held against one leader first, which joins most of a large
group of copies; the pairs that share a key and lie in different components after that are all compared: in keys of up to
``PAIR_NODES`` nodes as pairs, in larger ones in blocks of ``BLOCK`` nodes by numpy, a block against each other in a task of its own that
gives back only the links that join components. No pair that shares a key is left out, but for those that differ in more
than ``FIRST_BITS`` of their first word (3.6 standard errors above the mean at 0.8). Whether a pair is linked is decided by
the sets themselves: the shared part of their shingles' 32-bit hashes.

Defined results: a null, empty or blank text has no shingles and is linked with others of that kind; a text of fewer words
than a shingle is one shingle; very long texts are read whole; rows with equal ids each give a row; a component of null ids
alone has a null component_id; an empty table gives an empty result; only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .components import connected_components
from .golay import WORD_BITS, near_codewords
from .simhash import _shingles

WORDS, SEGMENTS, PAIR_NODES, BLOCK = 3, 8, 24, 512
#: Tables of keys or documents, of two or three numbers a row, are broadcast up to so many rows and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
FIRST_BITS = 20
#: Blocks look at pairs in full whose estimate, from as many bins of smallest hashes, is less than this under the similarity.
BINS, SLACK = 256, 0.08
_CHUNK = 1 << 13


def wide_print(text: str | None, n: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """SimHash words and min-hashes of a text's set of shingles, and the set: sorted 32-bit hashes."""
    import xxhash

    grams = _shingles(text, n) if text else []
    if not grams:
        return np.zeros(WORDS + SEGMENTS, np.uint64), np.empty(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    own = np.unique(np.fromiter((digest(g, seed) for g in grams), np.uint64, len(grams)))
    total, least = np.zeros(64 * WORDS, np.int64), np.full(SEGMENTS, ~np.uint64(0))
    step = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), _CHUNK):
        x = own[at : at + _CHUNK, None] + step  # further words are the mixed hash
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x = x ^ x >> np.uint64(31)
        least = np.minimum(least, x.min(axis=0))
        total += np.unpackbits(np.ascontiguousarray(x[:, :WORDS]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    words = np.packbits(2 * total > len(own), bitorder="little").view(np.uint64)
    return np.concatenate((words, least)), np.unique((own >> np.uint64(32)).astype(np.uint32))


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, a written table, to be broadcast if it is short."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))


def _prints(n: int, seed: int, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                marks, sets = zip(*(wide_print(t.as_py(), n, seed) for t in b.column(1)))
                raw = [s.tobytes() for s in sets]
                node = pa.array(np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw)).view(np.int64))
                if with_sets:
                    yield pa.RecordBatch.from_arrays([node, pa.array(raw, pa.binary())], ["node", "shingles"])
                else:
                    flat = pa.array(np.concatenate(marks).view(np.int64))
                    listed = pa.FixedSizeListArray.from_arrays(flat, WORDS + SEGMENTS).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), node, listed], ["id", "text_hash", "node", "marks"])

    return run


def wide_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, seed: int = 42) -> DataFrame:
    """``(id, text_hash, node, marks)``: hash of the set of shingles, and words and min-hashes, of every document."""
    source = _source(docs, id_col, text_col)
    return source.mapInArrow(_prints(n, seed, False), f"id {source.schema['id'].dataType.simpleString()}, text_hash long, node long, marks array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, seed: int = 42) -> DataFrame:
    """``(node, shingles)`` of ``nodes`` (first: id and text hash of a document that has it), made from their texts again.

    The sets of all documents take as much room as the texts; few of them share a key with another.
    """
    first = _small(nodes.select(F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash")))
    source = _source(docs, id_col, text_col)
    wanted = source.join(first, source["id"].eqNullSafe(first["first_id"]) & source["text_hash"].eqNullSafe(first["first_hash"]), "left_semi")
    return wanted.mapInArrow(_prints(n, seed, True), "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def segment_keys(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: for each segment of each row up to six keys, a min-hash mixed with a codeword index."""
    bits = np.unpackbits(np.ascontiguousarray(marks[:, :WORDS]).view(np.uint8).reshape(len(marks), -1), axis=1, bitorder="little")
    least = marks[:, WORDS:].view(np.uint64)
    place = 1 << np.arange(WORD_BITS)
    rows, keys = [], []
    for t in range(SEGMENTS):
        index, n = near_codewords(bits[:, t * WORD_BITS : (t + 1) * WORD_BITS] @ place)
        row, i = np.nonzero(np.arange(6) < n[:, None])
        rows.append(row)
        keys.append(least[row, t] ^ (index[row, i].astype(np.uint64) + np.uint64(t << 12)) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            marks = np.asarray(b.column(1).flatten()).reshape(-1, WORDS + SEGMENTS).copy()
            row, key = segment_keys(marks)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.asarray(b.column(0))[row]), pa.array(marks[row, 0])], ["key", "node", "word"])


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets of 32-bit numbers, each sorted."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            # The smaller set's share bounds the similarity.
            good = [min(len(x), len(y)) >= similarity * max(len(x), len(y)) and jaccard(x, y) >= similarity for x, y in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (u, v) whose sets are alike."""
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("u", "v"))
    return _small(pairs).join(a, "u").join(b, "v").select("u", "v", "set_u", "set_v").mapInArrow(_alike(similarity), "u long, v long")


def _near(one: Column, other: Column) -> Column:
    return F.bit_count(one.bitwiseXOR(other)) <= FIRST_BITS


def _sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Per set the smallest rest of the hashes in each of ``BINS`` bins; all ones where a bin has none."""
    out = np.full((len(sets), BINS), 0xFFFFFFFF, np.uint32)
    for row, s in zip(out, sets):
        mixed = s * np.uint32(0x9E3779B1)
        np.minimum.at(row, mixed % BINS, mixed >> np.uint32(8))
    return out


def block_links(nodes: np.ndarray, roots: np.ndarray, words: np.ndarray, sets: list[np.ndarray], left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join different roots, of rows where ``left`` holds with all others; of all with each other if it holds for all."""
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while (n := up.get(r, r)) != r:
            r = n
        return r

    words = words.view(np.uint64)  # of signed numbers, numpy counts the absolute value's bits
    sketch, sizes, found = _sketch(sets), np.array([len(s) for s in sets]), []
    whole = bool(left.all())
    for i in np.flatnonzero(left):
        others = np.arange(i + 1, len(nodes)) if whole else np.flatnonzero(~left)
        own = find(int(roots[i]))
        others = others[(roots[others] != roots[i]) & (np.bitwise_count(words[others] ^ words[i]) <= FIRST_BITS)]
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        there = (sketch[others] != 0xFFFFFFFF) | (sketch[i] != 0xFFFFFFFF)
        same = ((sketch[others] == sketch[i]) & there).sum(axis=1)
        others = others[same >= (similarity - SLACK) * there.sum(axis=1)]
        for j in others:
            if find(int(roots[j])) != own and jaccard(sets[i], sets[j]) >= similarity:
                found.append((int(nodes[i]), int(nodes[j])))
                up[find(int(roots[j]))] = own
    return found


def _blocks(similarity: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, roots, words, own, side = (rows[c].to_numpy() for c in ("node", "root", "word", "block", "low"))
        sets = [np.frombuffer(s, np.uint32) for s in rows["shingles"].to_pylist()]
        links = block_links(nodes, roots, words, sets, own == side, similarity)
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return run


def near_copy_links(shared: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``shared`` (key, node, word) and the nodes' sets to ``(node, root)`` for every node with a link: its component's smallest node."""
    leaders = shared.groupBy("key").agg(F.min_by(F.struct("node", "word"), F.xxhash64("node")).alias("leader"))
    met = shared.join(leaders, "key").filter((F.col("node") != F.col("leader.node")) & _near(F.col("word"), F.col("leader.word")))
    pairs = written(met.select(F.least("node", "leader.node").alias("u"), F.greatest("node", "leader.node").alias("v")).distinct(), "pairs")
    first = written(_verified(pairs, sets, similarity), "first")
    roots = connected_components(first)

    # All other pairs of a key, where it still holds several components.
    held = written(shared.join(roots, "node", "left").select("key", "node", "word", F.coalesce("root", "node").alias("root")), "held")
    counted = held.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z AND n > 2").select("key", "n")
    apart = written(held.join(counted, "key"), "apart")
    small = apart.filter(F.col("n") <= PAIR_NODES).groupBy("key").agg(F.collect_list(F.struct("node", "word", "root")).alias("all"))
    two = small.select(F.explode("all").alias("u"), "all").select("u", F.explode(F.filter("all", lambda v: (v["node"] > F.col("u.node")) & (v["root"] != F.col("u.root")) & _near(v["word"], F.col("u.word")))).alias("v"))
    others = written(two.select("u.node", F.col("v.node").alias("other")).toDF("u", "v").distinct().join(pairs, ["u", "v"], "left_anti"), "others")
    few = _verified(others, sets, similarity)

    large = apart.filter(F.col("n") > PAIR_NODES).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = large.select("key", "node", "word", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("key", "node", "word", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    many = each.join(sets, "node").groupBy("key", "low", "high").applyInArrow(_blocks(similarity), "u long, v long")

    out = connected_components(first.union(few).union(many))
    for done in (pairs, first, held, apart, others):
        drop_written(done)
    return out


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``(id, text_hash, fp, component_id)``, a row per document; component_id is the smallest id that links reach."""
    prints = written(wide_prints(docs, id_col, text_col, n, seed), "prints")
    nodes = written(prints.groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("id", "text_hash")).alias("first"), F.min("marks").alias("marks")), "nodes")
    # Most keys are one node's alone and go before their rows are dealt out.
    keyed = nodes.select("node", "marks").mapInArrow(_keyed, "key long, node long, word long")
    often = written(keyed.groupBy("key").count().filter("count > 1").select("key"), "often")
    shared = written(keyed.join(_small(often), "key", "left_semi"), "shared")
    involved = written(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "first"), "involved")
    sets = written(shingle_sets(docs, involved, id_col, text_col, n, seed), "sets")
    roots = near_copy_links(shared, sets, similarity)
    rooted = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = written(rooted.join(lowest, "root").select("node", "component_id"), "classes")
    for done in (nodes, often, shared, involved, sets, roots):
        drop_written(done)
    return prints.select("id", "text_hash", "node").join(by_node, "node").select(F.col("id").alias(id_col), "text_hash", F.col("node").alias("fp"), "component_id")
