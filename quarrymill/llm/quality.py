"""Operator 6: a regularised quadratic discriminant over document statistics (``features``, ``fit``, ``score``).

A document's statistics are counts and shares of kinds of characters, words and lines, transformed (logarithms of
counts, square roots of shares) and standardised. Each class has a mean and a covariance; the covariance is shrunk
towards the one of all classes and then towards a multiple of the identity. The score is the class probability from
the difference of the two Mahalanobis log densities, with the Cholesky factors computed once and kept.

Fitting needs only each class's count, sum and sum of products of the statistics: Spark adds them up over all labelled
rows (no sample) and one row per class reaches the driver.

Defined results: a null, empty or blank text has all counts zero and gets a score like any other; labels other than 0
and 1 and labels without a document don't count, repeated rows of either table count as often as they are there; very long texts are measured whole; extra columns may have any name; with
one class labelled the score is that class's value, with none it is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shrinkage of a class's covariance towards the pooled one, and of that towards the identity.
TOWARDS_POOLED, TOWARDS_IDENTITY = 0.1, 0.05

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = b"0123456789"
_STOPS = b".,;:?'\"-()"
_MARKS = b"#*$%&|<>!=+@^~_/\\{}[]"
_CONTINUATION = bytes(range(0x80, 0xC0))
FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "stops", "marks", "marked_words", "bare_marks", "distinct_words",
    "commonest_word", "same_as_before", "repeated_lines", "repeated_triples", "longest_word", "worst_line_marks", "worst_line_upper", "worst_line_repeats",
)


def _share(part: float, whole: float) -> float:
    return math.sqrt(part / whole) if whole else 0.0


def _line_worst(line: bytes) -> tuple[float, float, float]:
    words = line.split()
    n = len(line)
    marks = (n - len(line.translate(None, _MARKS))) / n
    upper = (n - len(line.translate(None, _UPPER))) / n
    return marks, upper, 1 - len(set(words)) / len(words)


def text_features(text: bytes | None) -> list[float]:
    """The transformed statistics of one text (UTF-8), in the order of FEATURES."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text.translate(None, _CONTINUATION))
    gone = {k: size - len(text.translate(None, v)) for k, v in (("upper", _UPPER), ("digits", _DIGIT), ("stops", _STOPS), ("marks", _MARKS))}
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = [w for w in words if w[-1:] in _MARK_SET]
    long_lines = [_line_worst(x) for x in set(lines) if len(x) >= 40]
    triples = n - 2
    return [
        math.log1p(chars),
        math.log1p(n),
        math.log1p(len(lines)),
        math.log1p(lengths.mean()),
        math.log1p(lengths.std()),
        _share(gone["upper"], size),
        _share(gone["digits"], size),
        _share(gone["stops"], size),
        _share(gone["marks"], size),
        _share(len(marked), n),
        _share(sum(c for w, c in counts.items() if not w.strip(_MARKS)), n),
        _share(len(counts), n),
        _share(max(counts.values()), n),
        _share(sum(map(bytes.__eq__, words, words[1:])), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(triples - len(set(zip(words, words[1:], words[2:]))), triples) if triples > 0 else 0.0,
        math.log1p(lengths.max()),
        math.sqrt(max((x[0] for x in long_lines), default=0.0)),
        math.sqrt(max((x[1] for x in long_lines), default=0.0)),
        math.sqrt(max((x[2] for x in long_lines), default=0.0)),
    ]


_MARK_SET = frozenset(bytes([b]) for b in _MARKS)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: the statistics of every document as an array of doubles."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """A fitted model; ``factors`` are the inverses of the Cholesky factors of the shrunk covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: list[np.ndarray]
    constants: list[float]
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.centre) / self.scale
        log_density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def fit(labelled: DataFrame, towards_pooled: float = TOWARDS_POOLED, towards_identity: float = TOWARDS_IDENTITY) -> Discriminant:
    """``labelled`` (x, y) with y 0 or 1 to a model."""
    k = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: np.zeros((k + 1, k + 1)), 1: np.zeros((k + 1, k + 1))}
        for b in batches:
            y = np.asarray(b.column(1))
            x = np.column_stack((np.ones(b.num_rows), np.asarray(b.column(0).flatten()).reshape(b.num_rows, k)))
            for c, m in held.items():
                m += x[y == c].T @ x[y == c]
        cells = [(c, i, float(v)) for c, m in held.items() for i, v in enumerate(m.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array([v[j] for v in cells]) for j in range(3)], ["y", "cell", "v"])

    cells = labelled.filter("y IN (0, 1)").select("x", F.col("y").cast("int").alias("y")).mapInArrow(sums, "y long, cell long, v double")
    total = {c: np.zeros((k + 1) ** 2) for c in (0, 1)}
    for r in cells.groupBy("y", "cell").agg(F.sum("v").alias("v")).collect():  # two classes of a fixed number of cells
        total[r["y"]][r["cell"]] = r["v"]
    m = [total[c].reshape(k + 1, k + 1) for c in (0, 1)]
    n = np.array([a[0, 0] for a in m])
    if not n.all():
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), [], [], 0.5 if not n.any() else float(n[1] > 0))
    both = m[0] + m[1]
    centre = both[0, 1:] / both[0, 0]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre**2, 0))
    scale[scale < 1e-9] = 1
    means = np.array([(a[0, 1:] / a[0, 0] - centre) / scale for a in m])
    own = [(a[1:, 1:] / a[0, 0] - np.outer(a[0, 1:], a[0, 1:]) / a[0, 0] ** 2) / np.outer(scale, scale) for a in m]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, constants = [], []
    for i, cov in enumerate(own):
        cov = (1 - towards_pooled) * cov + towards_pooled * pooled
        cov = (1 - towards_identity) * cov + towards_identity * max(np.trace(cov) / k, 1e-6) * np.eye(k)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(float(math.log(n[i] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, means, factors, constants)


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """``measured`` (id, x) to ``(id, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["id", "score"])

    return measured.select("id", "x").mapInArrow(run, f"id {measured.schema['id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that a score never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_labels(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled documents that are not held out; ``labels`` has doc_id and quality."""
    learn = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
    return fit(measured.join(learn, measured["id"] == F.col("_id")).select("x", "y"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = ((t.as_py() or "").encode() for t in b.column(at))
            x = np.array([text_features(t) for t in texts]).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
