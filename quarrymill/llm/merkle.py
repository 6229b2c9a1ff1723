"""Operator 13: a Merkle manifest of a dataset (``leaf_digest``, ``manifest``, ``folded_root``), by contiguous digest matrices.

The leaves of a tree get their places in id order (``places.py``) and fall into aligned blocks of ``fanout ** LEVELS``.
A block is one numpy matrix of 64-byte hex digests: its rows are reshaped by the fanout and hashed level by level, the
blocks' digests are the next round's leaves, so that no task holds more of a tree than a block. The trees' digests are
the leaves of one tree over all. On the way back every block receives the siblings of its own digest and adds those of
its leaves, found by index arithmetic in the same matrices.

Nodes are hashed as text: the digest of a run is the sha256, in lowercase hex, of its digests one after the other. A run
that is alone at its level ends the tree; the last run of a level may be shorter, down to one digest, and is hashed alike.

Defined results: a null value counts as ``-`` in a leaf and an empty one as ``0:``; very long texts are hashed whole; a
null tree is a tree of its own and comes first; null ids come first in their tree; rows with equal ids are ordered by
their leaves, equal rows each have a leaf; a lone leaf is its tree's digest and has no siblings there; an empty table
gives an empty manifest; further columns come back as they were, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import written
from .places import with_places

#: Levels of a block: with a fanout of 16 a block has up to 256 digests.
LEVELS = 2
_HEX = 64
_PATH = "tree string, at long, places array<int>, others array<int>, siblings string, subroot string, root string"


def leaf_digest(*columns: Column) -> Column:
    """sha256 in hex of the values one after the other: ``-`` if null, else the UTF-8 length, ``:`` and the value as text."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def level_matrices(leaves: np.ndarray, fanout: int, levels: int | None = None) -> list[np.ndarray]:
    """The digests of every level, ``(n, 64)`` bytes each: ``levels`` of them above the leaves, or until one digest remains."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        whole = len(now) // fanout * fanout
        runs = list(now[:whole].reshape(-1, fanout * _HEX))
        if whole < len(now):
            runs.append(now[whole:].ravel())
        out.append(np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, _HEX))
    return out


def siblings_of(i: int, matrices: list[np.ndarray], fanout: int) -> tuple[list[int], list[int], bytes]:
    """Place in its run, number of siblings, and the siblings themselves, for leaf ``i`` at each level below the last."""
    places, others, found = [], [], []
    for level in matrices[:-1]:
        start = i // fanout * fanout
        end = min(start + fanout, len(level))
        places.append(i - start)
        others.append(end - start - 1)
        found += (level[start:i].tobytes(), level[i + 1 : end].tobytes())
        i //= fanout
    return places, others, b"".join(found)


def fold(leaf: str, places: list[int], others: list[int], siblings: str) -> str:
    """The digest that a leaf and its siblings lead to."""
    at = 0
    for place, n in zip(places, others):
        cut, end = at + place * _HEX, at + n * _HEX
        leaf = hashlib.sha256((siblings[at:cut] + leaf + siblings[cut:end]).encode()).hexdigest()
        at = end
    return leaf


def _matrices(block: pa.Table, fanout: int) -> list[np.ndarray]:
    """Of a block's rows in order of ``at``. A tree that has further blocks has all levels in each."""
    digests = np.frombuffer("".join(block["digest"].to_pylist()).encode(), np.uint8).reshape(-1, _HEX)
    return level_matrices(digests, fanout, LEVELS if block["n"][0].as_py() > fanout**LEVELS else None)


def _up(fanout: int):
    size = fanout**LEVELS

    def run(key: tuple, block: pa.Table) -> pa.Table:
        tree, at = (k.as_py() for k in key)
        block = block.sort_by("at")
        top = _matrices(block, fanout)[-1].tobytes().decode()
        return pa.table({"tree": pa.array([tree], pa.string()), "at": [at], "n": [-(-block["n"][0].as_py() // size)], "digest": [top]})

    return run


def _down(fanout: int, names: list[str], checked: bool):
    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        matrices = _matrices(block, fanout)
        (up,) = above.to_pylist()
        own = [siblings_of(i, matrices, fanout) for i in range(block.num_rows)]
        found: dict = {
            "places": pa.array([p + up["places"] for p, _, _ in own], pa.list_(pa.int32())),
            "others": pa.array([o + up["others"] for _, o, _ in own], pa.list_(pa.int32())),
            "siblings": [s.decode() + up["siblings"] for _, _, s in own],
            "subroot": pa.array([up["subroot"]] * block.num_rows, pa.string()),
            "root": pa.array([up["root"]] * block.num_rows, pa.string()),
        }
        if checked:
            leaves = zip(block["checked"].to_pylist(), found["places"].to_pylist(), found["others"].to_pylist(), found["siblings"])
            found["folded_root"] = pa.array([None if x[0] is None else fold(*x) for x in leaves], pa.string())
        return pa.table({n: block[n] for n in names} | found)

    return run


def _rounds(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """``nodes`` (tree, at, n, digest) and the digests of their blocks, round by round until every tree has one."""
    size, out = fanout**LEVELS, [nodes]
    most = nodes.agg(F.max("n")).head()[0] or 1
    while most > 1:
        blocks = out[-1].filter("n > 1").groupBy("tree", F.expr(f"at div {size}").alias("block"))
        out.append(written(blocks.applyInArrow(_up(fanout), "tree string, at long, n long, digest string"), "digests"))
        most = -(-most // size)
    return out


def _paths(rounds: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """What leads from every node of the first round to the root, where ``tops`` has what leads there from each tree's digest."""
    size, found = fanout**LEVELS, None
    for k, nodes in reversed(list(enumerate(rounds))):
        ended = tops.join(nodes.filter("n = 1").select("tree"), "tree", "left_semi")
        above = ended if found is None else ended.unionByName(found.select(ended.columns))
        names = [c for c in nodes.columns if c != "n"]
        checked = "checked" in names
        schema = ", ".join([*(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in names), *_PATH.split(", ")[2:], *["folded_root string"] * checked])
        blocks = nodes.groupBy("tree", F.expr(f"at div {size}").alias("block"))
        above = above.select(F.col("tree").alias("to_tree"), F.col("at").alias("to_block"), *above.columns[2:])
        found = blocks.cogroup(above.groupBy("to_tree", "to_block")).applyInArrow(_down(fanout, names, checked), schema)
        if k:
            found = written(found, "paths")
    return found


def manifest(leaves: DataFrame, tree_col: str = "source", id_col: str = "doc_id", leaf_col: str = "leaf", fanout: int = 16, checked_col: str | None = None) -> DataFrame:
    """The rows of ``leaves`` with ``places``, ``others``, ``siblings``, ``subroot`` and ``root``: each leaf's proof, from its tree to the root.

    ``siblings`` has the digests of all levels, from the leaf's own up, left to right; ``others`` says how many belong to
    a level and ``places`` how many of these stand before the node itself. With ``checked_col``, digests that stand where
    the leaves did, ``folded_root`` is the root that they and the leaves' siblings lead to, in the same pass.
    """
    check = [leaves[checked_col].alias("checked")] if checked_col else []
    # A null tree sorts before all others, the empty name among them.
    tree = F.coalesce(F.concat(F.lit("="), leaves[tree_col]), F.lit(""))
    rows = leaves.select(tree.alias("tree"), leaves[id_col].alias("id"), leaves[leaf_col].alias("digest"), *check, F.struct("*").alias("own"))
    placed = with_places(rows, "tree", ["id", "digest"], "leaves")
    rounds = _rounds(placed.select("tree", "at", "n", "digest", *["checked"] * len(check), "own"), fanout)
    subroots = reduce(DataFrame.unionByName, [r.filter("n = 1").select("tree", "digest") for r in rounds])
    trees = with_places(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"], "trees")
    upper = _rounds(trees.select("tree", "at", "n", "digest", "name"), fanout)
    nothing = F.array().cast("array<int>")
    top = upper[-1].select("tree", "at", nothing.alias("places"), nothing.alias("others"), F.lit("").alias("siblings"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = _paths(upper, top, fanout).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), "places", "others", "siblings", F.col("digest").alias("subroot"), "root")
    return _paths(rounds, written(tops, "tops"), fanout).select("own.*", "places", "others", "siblings", "subroot", "root", *["folded_root"] * len(check))


def folded_root(proofs: DataFrame, leaf_col: str, into: str = "folded_root") -> DataFrame:
    """``proofs`` (of ``manifest``) with the root that the digests of ``leaf_col`` and their siblings lead to."""

    def run(batches):
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (leaf_col, "places", "others", "siblings")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fold(*x) for x in zip(*columns)], pa.string())], [*b.schema.names, into])

    return proofs.mapInArrow(run, StructType([*proofs.schema, StructField(into, StringType())]))
