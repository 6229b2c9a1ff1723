"""The driver's queries for the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_count import count_tokens
from .common import fresh_path, table, written
from .decontaminate import contamination
from .divergence import divergence
from .licences import CUE, LICENCE_NAME, MIN_COSINE, STATED, TEMPLATES, TERM, TEXT_WORDS, licence_scan
from .main_text import extract_main_text
from .merkle import leaf_digest, manifest
from .mixing import plan_mix
from .piecewise import next_likeness
from .quality import features, fit_on_labels, held_out, score
from .repetition import repetition_rules
from .secrets_scan import KINDS, scan_secrets, span_text
from .simhash import near_duplicate_groups
from .token_file import read_tokens, write_tokens


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token_file")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).withColumnRenamed("id", "doc_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(features(table(spark, sf_dir, "documents")), "features")
    scored = score(measured, fit_on_labels(measured, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return licence_scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "licence", "origin", "cosine")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda p: p["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op11_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_likeness(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before, lowered = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_digest(*before, F.col("text")).alias("leaf"), F.when(tampered, leaf_digest(*before, lowered)).alias("altered"))
    told = manifest(written(leaves.withColumn("altered", F.coalesce("altered", "leaf")), "leaf_digests"), checked_col="altered")
    return told.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT DISTINCT rid, n, s, win FROM dw WHERE win IN (SELECT win FROM bw)
), words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit JOIN bw USING (win) WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source
), w AS (
  SELECT *, (place % 3 + 1)::BIGINT AS weight, source_size * 3 AS most FROM per
), run AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::BIGINT AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight
  FROM w WINDOW b AS (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT *, left_size * weight <= most * left_weight AS open,
         max(CASE WHEN left_size * weight <= most * left_weight THEN left_size::DOUBLE / left_weight END) OVER () AS level FROM run
), t AS (
  SELECT source, source_size, coalesce(CASE WHEN open THEN weight * level ELSE most::DOUBLE END, 0.0) AS target FROM lev
), d AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         md5('mix:' || coalesce(s.doc_id::VARCHAR, '')) AS digest
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), tries AS (
  SELECT *, size * (floor(rate)::BIGINT + CASE WHEN (('0x' || substr(digest, seed // 16 * 8 + 1, 8))::BIGINT + seed % 16 * 268435456) % 4294967296 < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END) AS taken
  FROM d, (SELECT unnest(range(64)) AS seed)
), pick AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed FROM (
    SELECT source, seed, abs(sum(taken) - any_value(target)) AS off FROM tries GROUP BY source, seed) GROUP BY source
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM tries JOIN pick ON tries.source IS NOT DISTINCT FROM pick.source AND tries.seed = pick.seed
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
OP9_SQL = rf"""
WITH files AS (
  SELECT doc_id, text, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(doc_id::VARCHAR, '') AS path FROM documents
), f AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files
), lines AS (
  SELECT path, line, max(n_words) AS n_words FROM (
    SELECT path, len(regexp_extract_all(text, '[^ 	-
]+')) AS n_words, unnest(string_split(text, chr(10))) AS line FROM f
  ) WHERE regexp_matches(line, '{CUE}') GROUP BY path, line
), total AS (SELECT count(*)::DOUBLE AS n FROM lines
), templates(no, licence, text) AS (VALUES {_TEMPLATE_ROWS}
), tt AS (SELECT no, licence, term, count(*) AS tf FROM (SELECT no, licence, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM templates) GROUP BY ALL
), counted AS (SELECT path, line, n_words, term, count(*) AS tf FROM (SELECT path, line, n_words, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines) GROUP BY ALL
), vocab AS (
  SELECT term, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt)
  LEFT JOIN (SELECT term, count(*) AS df FROM counted GROUP BY term) USING (term), total
), known AS (SELECT no, licence, term, tf * idf AS tw, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY no)) AS t_norm FROM tt JOIN vocab USING (term)
), weighted AS (
  SELECT *, sqrt(sum(w * w) OVER (PARTITION BY path, line)) AS norm FROM (
    SELECT path, line, n_words, term, tf * coalesce(idf, ln((1.0 + n) / 2.0) + 1) AS w FROM counted LEFT JOIN vocab USING (term), total)
), near AS (
  SELECT path, line, n_words, licence, round(sum(w * tw) / (any_value(norm) * any_value(t_norm)), 6) AS cosine
  FROM weighted JOIN known USING (term) GROUP BY path, line, n_words, no, licence HAVING round(sum(w * tw) / (any_value(norm) * any_value(t_norm)), 6) >= {MIN_COSINE}
), best AS (SELECT path, line, n_words, max(cosine) AS c FROM near GROUP BY ALL
), own AS (
  SELECT path, arg_min(licence, (-cosine, licence)) AS own, max(cosine) AS cosine FROM near GROUP BY path
), stated AS (
  SELECT path, min(regexp_replace(s, '[.-]+$', '')) AS stated FROM (SELECT path, regexp_extract(line, '{STATED}', 1) AS s FROM lines) WHERE s <> '' GROUP BY path
), held AS (
  SELECT path, sum(len(regexp_extract_all(line, '[^ 	-
]+'))) AS held, max(n_words) AS n_words FROM best GROUP BY path
), ownf AS (
  SELECT path, coalesce(stated, own) AS own, cosine, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_NAME}') AS is_named,
         regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_NAME}') OR coalesce(n_words >= {TEXT_WORDS} AND 2 * held >= n_words, false) AS is_file
  FROM own FULL JOIN stated USING (path) LEFT JOIN held USING (path)
), by_dir AS (
  SELECT dir AS above, arg_min(own, (NOT is_named, -n, own)) AS licence FROM (
    SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, is_named, own, count(*) AS n FROM ownf WHERE is_file GROUP BY ALL) GROUP BY dir
), anc AS (
  SELECT dir, d AS depth, array_to_string(string_split(dir, '/')[1:d], '/') AS above
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS d FROM (SELECT DISTINCT dir FROM f))
), nearest AS (SELECT dir, arg_max(licence, depth) AS inherited FROM anc JOIN by_dir USING (above) GROUP BY dir)
SELECT doc_id, f.path, coalesce(own, inherited, '') AS licence,
       CASE WHEN own IS NULL THEN CASE WHEN inherited IS NULL THEN 'none' ELSE 'inherited' END WHEN is_file THEN 'file' ELSE 'header' END AS origin,
       coalesce(cosine, 0.0)::DOUBLE AS cosine
FROM f LEFT JOIN ownf ON f.path = ownf.path LEFT JOIN nearest ON f.dir = nearest.dir
"""

OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x60\x7B-\x7F]+') AS words FROM documents
), grp AS (SELECT DISTINCT lang, source FROM d
), each AS (SELECT rid, lang, source, unnest(words) AS term FROM d
), kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cnt AS (SELECT lang, source, term, count(*) AS c FROM each JOIN kept USING (lang, term) GROUP BY ALL
), tot AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL
), ltot AS (SELECT lang, sum(c) AS n FROM cnt GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
  FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN tot USING (lang, source) LEFT JOIN cnt USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS q
  FROM cnt JOIN ltot USING (lang) JOIN size USING (lang) GROUP BY lang, term
), val AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM size)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM val)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


def _tree_sql(name: str, levels: int, fanout: int = 16) -> str:
    """``{name}0`` (tree, pos, digest, n) and every level above it, as CTEs; a level of one digest is the last of its tree."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_runs{k} AS (
  SELECT tree, pos // {fanout} AS pos, list(digest ORDER BY pos) AS run, (any_value(n) + {fanout - 1}) // {fanout} AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // {fanout}
), {name}{k + 1} AS (SELECT tree, pos, sha256(array_to_string(run, '')) AS digest, n FROM {name}_runs{k})""")
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join(out) + f", {name}_tops AS ({tops})"


def _climb_sql(name: str, start: str, levels: int, fanout: int = 16) -> str:
    """From ``start`` (rid, tree, pos, ...; ``proof`` and ``folded`` so far) through every level of the trees."""
    out, last = [], start
    for k in range(levels):
        place = f"(c.pos % {fanout})::INTEGER"
        out.append(f"""{name}_climb{k} AS (
  SELECT rid, c.tree, c.pos // {fanout} AS pos,
         CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(r.run[:{place}] || r.run[{place} + 2:], '') END AS proof,
         CASE WHEN r.run IS NULL THEN folded ELSE sha256(array_to_string(r.run[:{place}], '') || folded || array_to_string(r.run[{place} + 2:], '')) END AS folded
  FROM {last} c LEFT JOIN {name}_runs{k} r ON c.tree = r.tree AND c.pos // {fanout} = r.pos)""")
        last = f"{name}_climb{k}"
    return ", ".join(out) + f", {name}_end AS (SELECT * FROM {last})"


#: Seven levels hold 16 ** 7 rows of a source.
OP13_SQL = rf"""
WITH crc(step) AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY i) FROM (SELECT unnest(range(256)) AS i)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format(text="text")} AS leaf,
         {_LEAF.format(text=f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS altered,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)))::BIGINT[], lambda x, y: xor(x >> 8, step[xor(x & 255, y) + 1])), 4294967295) % 5 = 0 AS tampered
  FROM documents, crc
), s AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), low0 AS (SELECT tree, pos, leaf AS digest, n FROM s), {_tree_sql("low", 7)},
high0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n FROM low_tops), {_tree_sql("high", 7)},
low_start AS (SELECT rid, tree, pos, '' AS proof, CASE WHEN tampered THEN altered ELSE leaf END AS folded FROM s), {_climb_sql("low", "low_start", 7)},
high_start AS (
  SELECT rid, '' AS tree, h.pos, proof, folded FROM low_end e JOIN (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low_tops) h ON e.tree = h.tree
), {_climb_sql("high", "high_start", 7)}
SELECT doc_id, leaf, low_tops.digest AS subroot, high_tops.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = high_tops.digest AS verified
FROM s JOIN high_end USING (rid) JOIN low_tops ON s.tree = low_tops.tree, high_tops
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_file": op1_token_file,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_main_text": op4_main_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_mix_sources": op8_mix_sources,
    "op9_licences": op9_licences,
    "op10_secrets": op10_secrets,
    "op11_piecewise_hash": op11_piecewise_hash,
    "op12_source_divergence": op12_source_divergence,
    "op13_manifest": op13_manifest,
}
SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op8_mix_sources": OP8_SQL, "op9_licences": OP9_SQL, "op12_source_divergence": OP12_SQL, "op13_manifest": OP13_SQL}
