"""Operator 5: quality rules with suffix-array repetition (``repetition_rules``).

The words of all documents of a group are numbered and sorted into one suffix array by prefix doubling. Ranks start
per document, so suffixes of different documents never tie, and only suffixes that still tie are refined. Kept ranks
of each doubling give the longest common prefix of neighbours. Every suffix's longest repeat is its larger prefix with
a neighbour: runs of neighbours that share a prefix are the LCP intervals, and those that can't be extended to the
left are the maximal repeated substrings. The union of their spans must stay under ``max_covered`` of the words, and
the longest under ``max_longest`` words.

Defined results: a null, empty or blank text has no words, fails the base rule (fewer than ten words) and isn't kept;
very long texts are measured whole, each in a group of its own; repeated rows give a row each; an empty table gives an
empty result; only id and text columns are read, others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Documents are taken in groups of about so many words; a longer document is a group of its own.
GROUP_WORDS = 200_000
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 6, 0.2, 50
SHINGLE = 5
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANK = re.compile(rb"[\x20\x09-\x0D]*\Z")


def _number(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 0 on."""
    numbers = dict.fromkeys(words)
    numbers = dict(zip(numbers, range(len(numbers))))
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def longest_repeats(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the length of the longest repeat (in its own document) that starts there.

    ``words`` has the numbered words of documents one after another, ``sizes`` how many each document has.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    ranks = [_ranks(key[order], order, n)]
    end = np.cumsum(sizes)[doc]  # one past the suffix's document
    step = 1
    while True:
        rank = ranks[-1]
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        beyond = tied + step
        inside = beyond < end[tied]
        second = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)  # a suffix that ends is before all others
        pair = rank[tied] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        tied, pair = tied[by], pair[by]
        # A rank is the place of the first suffix of its group; a group's new groups follow from there.
        group = rank[tied]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = group + np.arange(len(tied)) - np.repeat(head, np.diff(np.append(head, len(tied))))
        fresh = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        new = rank.copy()
        new[tied] = np.repeat(place[fresh], np.diff(np.append(fresh, len(tied))))
        if np.array_equal(new, rank):
            break
        ranks.append(new)
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[ranks[-1]] = np.arange(n)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    common = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        # Equal ranks at a level: equal for 2^level words, which lie inside the document for both.
        ok = (np.maximum(a, b) < n) & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)]) & (a != b)
        ok &= np.maximum(a, b) + (1 << level) <= end[suffix[:-1][live]]
        a, b, got = a + (ok << level), b + (ok << level), got + (ok << level)
    common[live] = got
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, suffix[:-1], common)
    np.maximum.at(longest, suffix[1:], common)
    return longest


def _ranks(sorted_keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    first = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return ranks


def _covered(length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many words of each document lie in spans of ``length`` that start at each word."""
    n = len(length)
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(length)
    change[:n] += length[:] > 0
    np.subtract.at(change, at + length[at], 1)
    return np.add.reduceat(np.append(np.cumsum(change[:n]) > 0, False), np.append(np.cumsum(sizes) - sizes, n))[:-1] * (sizes > 0) if n else np.zeros(len(sizes), np.int64)


def _maximal(length: np.ndarray, sizes: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: spans of maximal repeats (not extensible to the left), and the longest of them."""
    docs = len(sizes)
    n = len(length)
    start = np.cumsum(sizes) - sizes
    before = np.concatenate(([0], length[:-1]))
    before[start[sizes > 0]] = 0
    spans = (length >= min_repeat) & (before != length + 1)
    doc = np.repeat(np.arange(docs), sizes)
    count = np.bincount(doc[spans], minlength=docs)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, np.where(length >= min_repeat, length, 0))
    return count, longest


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if not _BLANK.match(x)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All measures of a group of texts (UTF-8)."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    longest = longest_repeats(_number([w for words in split for w in words]), sizes)
    spans, most = _maximal(longest, sizes, min_repeat)
    joined = [b"".join(w) for w in split]
    return {
        "n_words": sizes,
        "word_chars": np.array([len(j.translate(None, _CONTINUATION)) for j in joined], np.int64),
        "n_symbols": np.array([len(j) - len(j.translate(None, _SYMBOLS)) for j in joined], np.int64),
        "n_dup_lines": np.array([_line_repeats(t) if t else 0 for t in texts], np.int64),
        "n_repeat_words": _covered(np.where(longest >= SHINGLE, SHINGLE, 0), sizes),
        "n_covered": _covered(np.where(longest >= min_repeat, longest, 0), sizes),
        "n_spans": spans,
        "longest_repeat": most,
    }


def _word_groups(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") // 4
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, group_words: int = GROUP_WORDS
) -> DataFrame:
    """A row per document: the base measures, base_failed, the repeats' measures, and kept."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "n_spans", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in _word_groups(texts, group_words):
                m = measure(texts[a:z], min_repeat)
                failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                kept = ~failed & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), *(pa.array(m[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(kept)], ["id", *names, "base_failed", "kept"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def brute_force(text: str | None, min_repeat: int = MIN_REPEAT) -> dict[str, int]:
    """The same measures straight from their definitions, for tests on short texts."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    longest = [max((next((k for k in range(n - max(i, j)) if words[i + k] != words[j + k]), n - max(i, j)) for j in range(n) if j != i), default=0) for i in range(n)]
    grams = Counter(tuple(words[i : i + SHINGLE]) for i in range(n - SHINGLE + 1))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {p for i, k in enumerate(longest) if k >= min_repeat for p in range(i, i + k)}
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({p for i in range(n - SHINGLE + 1) if grams[tuple(words[i : i + SHINGLE])] > 1 for p in range(i, i + SHINGLE)}),
        "n_covered": len(covered),
        "longest_repeat": max((k for k in longest if k >= min_repeat), default=0),
    }
