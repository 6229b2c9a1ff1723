"""Operator 2: benchmark decontamination by winnowing (``benchmark_windows``, ``contamination``). DataFrame functions only.

A document keeps, for every sliding window of ten words, the smallest hash of the window's six 5-word grams; runs of
windows with the same smallest hash are one fingerprint. The benchmark's fingerprints are made alike, so that any
shared span of ten words has one in common. Documents' fingerprints are joined with them, and each hit is extended to
the windows of its run, whose words are compared in full. Items of fewer than ten words are one window of their own;
where there are such items, all grams of those lengths are looked up.

Hashes use full lower-casing, which is coarser than the contract's A-Z; the comparison of words in full uses A-Z only.

Defined results: a null or wordless text has no words and no hit; an item without words has no window; a null item id
makes hits but is not listed; repeated item rows count once, repeated document rows give a row each; an empty
benchmark leaves every document clean; only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, GRAM = 10, 5
#: A run of windows is cut after so many, which bounds the words that a fingerprint carries along.
RUN = 12
#: The benchmark side is broadcast up to this many windows and characters, and joined by shuffle beyond.
BROADCAST_WINDOWS, BROADCAST_CHARS = 500_000, 64 << 20
#: The contract's words, with A-Z not lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _with_hashes(df: DataFrame) -> DataFrame:
    """``words`` with ``n_words``, word hashes, gram hashes and the smallest gram hash of each window."""

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    df = df.withColumn("n_words", F.size("words")).withColumn("word_hash", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    grams = F.transform(F.slice("word_hash", 1, F.greatest(F.col("n_words") - (GRAM - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[at("word_hash", i + k) for k in range(1, GRAM)]))
    df = df.withColumn("gram_hash", grams)
    lowest = F.transform(F.slice("gram_hash", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0))), lambda h, i: F.least(h, *[at("gram_hash", i + k) for k in range(1, WINDOW - GRAM + 1)]))
    return df.withColumn("lowest", lowest)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _all_grams(size: int) -> Column:
    """Every gram of ``size`` words, as candidates that start and end there."""
    return F.when(
        F.col("n_words") >= size,
        F.transform(
            F.sequence(F.lit(0), F.col("n_words") - size),
            lambda i: F.struct(i.cast("int").alias("at"), F.lit(size).alias("size"), F.xxhash64(*[F.get("word_hash", i + k) for k in range(size)]).alias("print"), F.slice("words", i + 1, size).alias("context")),
        ),
    )


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(size, window, print, items)``: each window of the benchmark once, with the ids of the items that have it."""
    df = _with_hashes(items.select(items[id_col].cast("string").alias("item"), _words(items[text_col]).alias("words")))
    of_ten = F.transform("lowest", lambda h, i: F.struct(F.lit(WINDOW).alias("size"), F.slice("words", i + 1, WINDOW).alias("w"), h.alias("print")))
    short = F.when(F.col("n_words") > 0, F.array(F.struct(F.col("n_words").alias("size"), F.col("words").alias("w"), F.lit(0).cast("long").alias("print"))))
    windows = df.select("item", F.inline(F.when(F.col("n_words") >= WINDOW, of_ten).otherwise(short)))
    # A short item's print is the hash of its own words, as _all_grams makes it for documents.
    own = F.transform("w", lambda w: F.xxhash64(F.lower(w)))
    by_size = F.coalesce(*[F.when(F.col("size") == n, F.xxhash64(*[F.get(own, F.lit(k)) for k in range(n)])) for n in range(1, WINDOW)])
    windows = windows.withColumn("print", F.when(F.col("size") < WINDOW, by_size).otherwise(F.col("print")))
    return (
        windows.withColumn("window", F.translate(F.array_join("w", " "), _UPPER, _LOWER))
        .groupBy("size", "window", "print")
        .agg(F.collect_set("item").alias("items"))
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, text_hash, n_words, n_hit, item_ids)``: a row per document; item_ids is a sorted array of strings."""
    windows = written(benchmark_windows(items, item_id_col, item_text_col), "windows")
    held = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("window") + 16 * F.size("items")), F.lit(0)).alias("chars"), F.collect_set("size").alias("sizes")).head()
    small = held["n"] <= BROADCAST_WINDOWS and held["chars"] <= BROADCAST_CHARS
    bounded = F.broadcast if small else (lambda df: df)

    df = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), _words(docs[text_col]).alias("words"))
    df = _with_hashes(df)
    def start(h: Column, i: Column) -> Column:
        run = F.struct(i.alias("at"), F.lit(WINDOW).alias("size"), h.alias("print"), F.slice("words", i + 1, WINDOW + RUN - 1).alias("context"))
        return F.when((i % RUN == 0) | (h != F.get("lowest", i - 1)), run)

    runs = F.filter(F.transform("lowest", start), lambda r: r.isNotNull())
    # One more row stands for the document itself; it has a size that no window has.
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("size"), F.xxhash64("id").alias("print"), F.slice("words", 1, 0).alias("context")))
    wanted = [itself, *([runs] if WINDOW in held["sizes"] else []), *[F.coalesce(_all_grams(n), F.filter(itself, lambda _: F.lit(False))) for n in sorted(held["sizes"]) if n < WINDOW]]
    found = df.select("id", "text_hash", "n_words", F.inline(F.concat(*wanted)))

    prints = windows.select(F.col("size").alias("b_size"), F.col("print").alias("b_print")).distinct()
    found = found.join(bounded(prints), (F.col("size") == F.col("b_size")) & (F.col("print") == F.col("b_print")), "left").filter((F.col("size") == -1) | F.col("b_size").isNotNull())
    last = F.when(F.col("size") == -1, F.lit(0)).otherwise(F.size("context") - F.col("size"))
    found = found.withColumn("ahead", F.explode(F.sequence(F.lit(0), last)))
    window = F.when(F.col("size") == -1, F.concat(F.lit(" "), F.col("text_hash").cast("string"))).otherwise(F.translate(F.array_join(F.expr("slice(context, ahead + 1, size)"), " "), _UPPER, _LOWER))
    found = found.withColumn("window", window).drop("context")
    hits = found.join(bounded(windows.select(F.col("window").alias("b_window"), "items")), F.col("window") == F.col("b_window"), "left")

    span = F.when(F.col("b_window").isNotNull(), F.struct((F.col("at") + F.col("ahead")).alias("s"), F.col("size").alias("n")))
    per = hits.groupBy("id", "text_hash", "n_words").agg(
        F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"), F.count_if(F.col("size") == -1).alias("copies")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["s"] + x["n"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(acc["end"], x["s"]))).alias("n")),
        lambda acc: acc["n"],
    )
    per = per.withColumn("n_hit", covered).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per.select(F.col("id").alias(id_col), "text_hash", F.col("n_words").cast("long").alias("n_words"), "n_hit", "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have no word in an occurrence of a benchmark window."""
    found = contamination(docs, items, id_col, text_col).filter("n_hit > 0").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
    marked = docs.select(F.struct("*").alias("row"), docs[id_col].alias("own_id"), F.xxhash64(docs[text_col]).alias("own"))
    return marked.join(written(found, "contaminated"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), "left_anti").select("row.*")
