"""Operator 12: how sources of a language differ in their words (``wide_vectors``, ``divergence``), by wide term vectors.

The terms of a language that are in at least ``MIN_DOCS`` of its documents are kept. Each kept term is one row with a wide
vector: its counts in the sources of the language, pivoted into an array that is indexed by source. Higher-order functions
turn a vector into the contributions of the pairs of sources that have the term, which aggregation sums before the
shuffle. Terms that only one source of a pair has are summed by that source and their count, as the other's share is the
same for all of them. So the work follows the counts that there are, not terms times pairs.

With ``N`` the occurrences of kept terms in a group and ``V`` the number of kept terms, a term's share is
``p = 1 + floor(SCALE * (count + 1) / (N + V))``; a source against another or against the language differs by the sum of
``floor((p - q)^2 / q)``. All of it is integer arithmetic; counts that are too large for a long are
scaled as decimals.

Defined results: null texts, languages and sources are read as empty ones; a document without terms still makes its
group; very long texts are counted whole; repeated rows count each; terms of equal value are ranked by their UTF-8 bytes;
a language without kept terms has zero for every pair; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between terms, after A-Z were lower-cased.
_BREAK = r"[\x00-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts without other capital letters take the faster way."""
    others = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    return F.when(others, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, n_docs)``: occurrences of a term in a group and the documents with it.

    A text gives its words and its distinct words, so that both numbers come from one pass and one aggregation.
    """
    texts = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    texts = texts.select("lang", "source", F.split(folded(F.col("text")), _BREAK).alias("words"))
    both = texts.select("lang", "source", F.posexplode(F.array("words", F.array_distinct("words"))).alias("once", "words"))
    each = both.select("lang", "source", "once", F.explode("words").alias("term")).filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("n_docs"))


def groups(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, i)``: every group that occurs, with the source's index in its language."""
    there = docs.select(F.coalesce(docs[lang_col], F.lit("")).alias("lang"), F.coalesce(docs[source_col], F.lit("")).alias("source")).distinct()
    return there.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))`` as a long, null where there are no terms.

    Counts that would leave a long when they are scaled are divided as decimals.
    """
    whole = total + terms
    plain = F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), whole)
    wide = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(terms > 0, F.when(count < 9_000_000_000, plain).otherwise(wide))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(counts: DataFrame, index: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, cells, counts)``: the kept terms with index and count of each source that has them, as pairs and as a map."""
    placed = counts.join(index, ["lang", "source"]).select("lang", "term", F.struct("i", "n").alias("cell"), "n_docs")
    return placed.groupBy("lang", "term").agg(F.collect_list("cell").alias("cells"), F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs).drop("n_docs").withColumn("counts", F.map_from_entries("cells"))


def language_totals(kept: DataFrame, index: DataFrame) -> DataFrame:
    """``(lang, sources, totals, total, n_terms, absent)``: names, occurrences of kept terms and shares of a term that is
    absent, all indexed by source."""
    each = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.i").alias("i")).agg(F.sum("cell.n").alias("total"))
    by_source = index.join(each, ["lang", "i"], "left").select("lang", F.struct("i", "source", F.coalesce("total", F.lit(0)).alias("total")).alias("g"))
    vectors = by_source.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("g"), F.sum("g.total").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    per = vectors.join(terms, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), "total", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    return per.withColumn("absent", F.transform("totals", lambda t: share(F.lit(0), t, F.col("n_terms"))))


def wide_vectors(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Each kept term with ``shares``, an array indexed by the sources of its language; those without the term have their absent share."""
    vector = F.transform("totals", lambda _, i: F.coalesce(F.try_element_at("counts", i), F.lit(0).cast("long")))
    shares = F.transform(vector, lambda n, i: share(n, F.get("totals", i), F.col("n_terms")))
    return kept.join(totals, "lang").withColumn("shares", shares).drop("counts")


def _gap(p: str, q: str) -> Column:
    return difference(F.col(p), F.col(q))


def pair_sums(wide: DataFrame) -> DataFrame:
    """``(lang, i, j, value)``: what terms that both sources have add to what they would add if one of them or both lacked them.

    A vector emits each source that has the term with all others that have it; the value of a pair is read off the vector
    once it is a row, in compiled code.
    """
    there = F.transform("cells", lambda c: c["i"])
    emitted = F.transform("there", lambda i: F.struct(i.alias("i"), F.filter("there", lambda j: j != i).alias("others")))
    held = wide.filter(F.size("cells") > 1).withColumn("there", there)
    each = held.select("lang", "shares", "absent", F.inline(emitted)).select("lang", "shares", "absent", "i", F.explode("others").alias("j"))
    p, q, no_p, no_q = (F.get(v, F.col(k)) for v, k in (("shares", "i"), ("shares", "j"), ("absent", "i"), ("absent", "j")))
    value = difference(p, q) - difference(p, no_q) - difference(no_p, q) + difference(no_p, no_q)
    return each.select("lang", "i", "j", value.alias("f")).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))


def pair_divergence(wide: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, other, value)`` for every two sources of a language.

    Terms that a source has with equal counts add the same wherever the other source lacks them, so that they are taken
    together by count; ``pair_sums`` puts those right that the other source has too.
    """
    terms = F.col("n_terms")
    one = totals.select("lang", "n_terms", "sources", "totals", "absent", F.posexplode("sources").alias("i", "source"))
    pairs = one.select("lang", "n_terms", "absent", "i", "source", F.posexplode("sources").alias("j", "other")).filter("i <> j")
    pairs = pairs.select("lang", "n_terms", "i", "j", "source", "other", F.get("absent", F.col("i")).alias("no_p"), F.get("absent", F.col("j")).alias("no_q"))

    cell = wide.select("lang", F.explode("cells").alias("cell"), "shares")
    counted = cell.groupBy("lang", F.col("cell.i").alias("k"), F.get("shares", F.col("cell.i")).alias("p")).agg(F.count("*").alias("m"))
    sides = counted.join(totals.select("lang", "absent"), "lang").select("lang", "k", "m", "p", F.get("absent", F.col("k")).alias("no_k"), F.posexplode("absent").alias("o", "no_o")).filter("k <> o")
    alone = sides.groupBy("lang", "k", "o").agg(F.sum("m").alias("m"), F.sum(F.col("m") * _gap("p", "no_o")).alias("up"), F.sum(F.col("m") * _gap("no_o", "p")).alias("down"))
    # As the first source of a pair and as the second.
    first = alone.select("lang", F.col("k").alias("i"), F.col("o").alias("j"), F.col("m").alias("m_i"), "up")
    second = alone.select("lang", F.col("o").alias("i"), F.col("k").alias("j"), F.col("m").alias("m_j"), "down")
    full = pairs.join(first, ["lang", "i", "j"], "left").join(second, ["lang", "i", "j"], "left").join(pair_sums(wide), ["lang", "i", "j"], "left")
    none = F.lit(0).cast("long")
    neither = terms - F.coalesce("m_i", none) - F.coalesce("m_j", none)
    value = F.coalesce("up", none) + F.coalesce("down", none) + F.coalesce("value", none) + F.coalesce(neither * _gap("no_p", "no_q"), none)
    return full.select("lang", "source", "other", value.alias("value"))


def marked_terms(wide: DataFrame) -> DataFrame:
    """``(lang, source, term, value)``: the terms that a source has and uses more than its language does."""
    whole = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    own = wide.withColumn("q", share(whole, F.col("total"), F.col("n_terms"))).select("lang", "term", "sources", "shares", "q", F.explode("cells.i").alias("i"))
    own = own.select("lang", F.get("sources", F.col("i")).alias("source"), "term", F.get("shares", F.col("i")).alias("p"), "q")
    return own.filter("p > q").select("lang", "source", "term", difference(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` ranks the other sources of a language, ``term`` the ``top`` terms that mark a source."""
    index = written(groups(docs, lang_col, source_col), "groups")
    kept = written(kept_terms(term_counts(docs, text_col, lang_col, source_col), index, min_docs), "terms")
    totals = written(language_totals(kept, index), "totals")
    wide = written(wide_vectors(kept, totals), "wide")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    pairs = ranked(pair_divergence(wide, totals).withColumnRenamed("other", "item"), "pair")
    terms = ranked(marked_terms(wide).withColumnRenamed("term", "item"), "term").filter(F.col("rank") <= top)
    return pairs.union(terms)
