"""Operator 1: token-id files coded with a static range asymmetric numeral system (``write_tokens``, ``read_tokens``).

A file is a folder of two Parquet tables, so that Spark's committer guards it against lost executors and any store that
Spark reaches can hold it:

``table``   id, freq: the frequencies that all blocks share; they sum to 2^18.
``blocks``  part, doc id, n_tokens, crc32 of the ids as little-endian unsigned 32-bit integers, the coded words, and
            the checkpoints (see ``rans``); part files are in ascending id order, and rows ascend within a part.

Writing takes three steps over Spark: encode with the tokenizers library (no shuffle) and count ids; range-partition
the coded documents, of which only the small coded form is shuffled; write. Reading decodes every block apart from the
others and checks each document's checksum.

Defined results: a null or empty text is the end id alone; very long texts are coded whole, in blocks; null ids come last;
rows with equal ids each get an entry (ordered by checksum, then by length); an empty table gives an empty file that reads
back empty; another vocabulary, which cuts texts in another way, is refused; only id and text columns are read, others may
have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, written
from .rans import Coder, table

#: Tokens that a part of the file aims at.
PART_TOKENS = 8_000_000
#: Pre-tokens whose ids a worker remembers before the older half goes.
MEMO_WORDS = 900_000
#: Documents are coded in groups of about so many ids at a time.
GROUP_TOKENS = 1_500_000


#: Documents are tokenized in groups of about so many bytes; a longer document is a group of its own.
GROUP_BYTES = 5_000_000
#: Texts of these characters alone are lower-cased alike by Python and the library, and stay as they are under NFC.
_LATIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba-\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203e]*")
# The vocabulary's pre-tokens other than runs of letters, for lower-cased texts of such characters.
_NOT_LETTERS = r"'(?:s|t|re|ve|m|ll|d)|[^\s\x0b\x{85}\x{a0}\p{L}\p{N}]+|\p{N}"
# How the vocabulary normalises and cuts texts, which the encoder relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Text to ids with the tokenizers library, which sees every distinct pre-token once while the memo holds it.

    No pre-token of the vocabulary spans white space and normalisation doesn't either, so with spaces around every
    pre-token that isn't a run of letters, the ids of a text are those of its white-space separated words. These are
    already normalised when the library gets them, so its copy here only splits at white space. Texts with other
    characters than Latin ones and common punctuation, or with a special string, go to the library whole.
    """

    def __init__(self, vocabulary: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec["normalizer"], spec["pre_tokenizer"]) != (NORMALIZER, PRE_TOKENIZER):
            raise ValueError("the vocabulary normalises or cuts texts in another way than this encoder")
        self.special = [t["content"] for t in spec["added_tokens"]]
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(ids.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        suffix = spec["model"].get("end_of_word_suffix") or "\0"
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for token, i in ids.items() if token.endswith(suffix)]] = True
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}}
        self.of_pre_tokens = Tokenizer.from_str(json.dumps(spec))
        self.limit, self.memo, self.old = max(1, memo_words // 2), {}, {}

    @cached_property
    def tok(self):
        """The library's tokenizer as it is, made only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _library(self, parts: list[str]) -> None:
        """Learn pre-tokens: many are encoded as one text, which is cut after the tokens that end a word."""
        width = self.dtype.itemsize
        for at in range(0, len(parts), 2000):
            group = parts[at : at + 2000]
            ids = np.array(self.of_pre_tokens.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            raw, cuts = ids.tobytes(), [0, *(ends * width).tolist()]
            self.memo.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens, learnt where neither half of the memo holds them."""
        if len(self.memo) > self.limit:
            self.old, self.memo = self.memo, {}
        self.memo[""] = b""  # outer white space cuts off empty words
        raw = list(map(self.memo.get, words))
        new = [i for i, r in enumerate(raw) if r is None]
        names = [words[i] for i in new]
        older = list(map(self.old.get, names))
        self.memo.update((w, r) for w, r in zip(names, older) if r is not None)
        self._library([w for w, r in zip(names, older) if r is None])
        for i, w in zip(new, names):
            raw[i] = self.memo[w]
        return raw

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, without an end id."""
        ids, sizes = self.encode_array(pa.array(texts, pa.string()), 0)
        return [own[:-1].tobytes() for own in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def encode_array(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: the ids of all texts one after another, ``end_id`` after each, and how many a text has.

        Arrow lowers, splits and numbers the words and puts their ids together again, so that Python meets each
        distinct word of the group once.
        """
        strings = texts.to_pylist()
        whole = [i for i, t in enumerate(strings) if t and (not _LATIN.fullmatch(t) or any(s in t for s in self.special))]
        mask = np.zeros(len(strings), bool)
        mask[whole] = True
        low = pc.utf8_lower(pc.if_else(pa.array(mask), "", pc.fill_null(texts, "")))
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(low, _NOT_LETTERS, r" \0 "))
        coded = cut.flatten().dictionary_encode()
        words, last = coded.dictionary.to_pylist(), np.asarray(cut.offsets)[1:].astype(np.int64)
        raw = self._ids_of(words)
        # After the words: the end id, then the texts that go to the library whole.
        raw += [np.array([end_id], self.dtype).tobytes(), *(np.array(self.tok.encode(strings[i], add_special_tokens=False).ids, self.dtype).tobytes() for i in whole)]
        number = np.insert(np.asarray(coded.indices), np.concatenate((last[whole], last)), np.concatenate((len(words) + 1 + np.arange(len(whole)), np.full(len(last), len(words)))))
        put = pa.array(raw, pa.large_binary()).take(pa.array(number))
        _, offsets, data = put.buffers()
        to = np.frombuffer(offsets, np.int64)[: len(number) + 1] // self.dtype.itemsize
        ids = np.frombuffer(data, self.dtype)[: to[-1]] if to[-1] else np.empty(0, self.dtype)
        return ids, np.diff(to[1:][number == len(words)], prepend=0)


@lru_cache(maxsize=2)
def _encoder(vocabulary: str | None) -> WordEncoder:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(vocabulary)


def _tokenise(vocabulary: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        counts = np.zeros(encoder.size, np.int64)
        names = ["id", "n_tokens", "ids", "counted", "counts"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for a, z in _groups(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), GROUP_BYTES):
                b = batch.slice(a, z - a)
                ids, n = encoder.encode_array(b.column(1), end_id)
                counts += np.bincount(ids, minlength=encoder.size)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32) * ids.itemsize
                coded = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), coded, none, none], names)
        if id_type is not None:
            seen = np.flatnonzero(counts)
            no_list, no_counts = pa.array([seen], pa.list_(pa.int64())), pa.array([counts[seen]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), no_list, no_counts], names)

    return run


def _groups(sizes: list[int], most: int = GROUP_TOKENS) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``most``; a larger document is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _encode(freq: np.ndarray, bounds: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, dtype = Coder(freq), np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            for a, z in _groups(batch.column(1).to_pylist()):
                b = batch.slice(a, z - a)
                raw, n = b.column(2).to_pylist(), np.asarray(b.column(1))
                ids = np.frombuffer(b"".join(raw), dtype)
                coded = coder.encode(ids, n)
                crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4")) for x in raw]
                key = b.column(0).to_pylist()
                part = [len(bounds) if k is None else int(np.searchsorted(bounds, k, side="left")) for k in key]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), b.column(0), b.column(1), pa.array(crc, pa.int64()), pa.array([w for w, _ in coded], pa.binary()), pa.array([m for _, m in coded], pa.binary())],
                    ["part", "id", "n_tokens", "crc32", "words", "marks"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, part_tokens: int = PART_TOKENS) -> None:
    """Encode every text, append ``end_id`` to each document and write the ids in ascending id order to ``path``."""
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    schema = "id long, n_tokens long, ids binary, counted array<long>, counts array<long>"
    tokens = written(source.mapInArrow(_tokenise(vocabulary, end_id), schema), "tokens", "zstd")

    counts = tokens.filter("counted IS NOT NULL").select(F.explode(F.arrays_zip("counted", "counts")).alias("c"))
    counted = counts.groupBy(F.col("c.counted").alias("id")).agg(F.sum("c.counts").alias("n")).collect()  # at most the vocabulary
    count = np.zeros(1 + max([end_id, *(r["id"] for r in counted)]), np.int64)
    for r in counted:
        count[r["id"]] = r["n"]
    freq = table(count)

    rows = tokens.filter("n_tokens IS NOT NULL").select("id", "n_tokens", "ids")
    parts = max(1, -(-int(count.sum()) // part_tokens))
    bounds = np.array(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], np.int64)
    bounds = np.unique(bounds)
    coded = rows.mapInArrow(_encode(freq, bounds, _wide(vocabulary)), "part int, id long, n_tokens long, crc32 long, words binary, marks binary")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_last(), "crc32", "n_tokens")
    ordered.write.option("compression", "snappy").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    drop_written(tokens)


def _wide(vocabulary: str | None) -> bool:
    return _encoder(vocabulary).dtype.itemsize > 2


def _decode(freq: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for a, z in _groups(batch.column(2).to_pylist()):
                b = batch.slice(a, z - a)
                n = np.asarray(b.column(2))
                ids, at = coder.decode(list(zip(b.column(4).to_pylist(), b.column(5).to_pylist())), n)
                ids = ids.astype("<u4")
                own = [ids[i : i + k] for i, k in zip(at.tolist(), n.tolist())]
                crc = [zlib.crc32(x) for x in own]
                if crc != b.column(3).to_pylist():
                    raise ValueError("a document's ids don't match its checksum")
                columns = [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["part", "id", "n_tokens", "crc32", "ids"][: len(columns)])

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])``: a row per document, decoded from the file and checked."""
    freq_rows = spark.read.parquet(f"{path}/table").collect()  # at most the vocabulary
    freq = np.zeros(1 + max((r["id"] for r in freq_rows), default=-1), np.int64)
    for r in freq_rows:
        freq[r["id"]] = r["freq"]
    blocks = spark.read.parquet(f"{path}/blocks")
    decoded = blocks.select("part", "id", "n_tokens", "crc32", "words", "marks").mapInArrow(_decode(freq, with_ids), "part int, id long, n_tokens long, crc32 long" + ", ids array<long>" * with_ids)
    before = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    placed = decoded.withColumn("inside", F.sum("n_tokens").over(before)).join(offsets, "part")
    start = F.coalesce("ahead", F.lit(0)) + F.coalesce("inside", F.lit(0))
    return placed.select("id", start.cast("long").alias("start"), "n_tokens", F.col("crc32").alias("ids_crc32"), *(["ids"] if with_ids else []))
