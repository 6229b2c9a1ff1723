"""Operator 10: secret scans with multipart credential linking (``secret_spans``, ``link_credentials``). DataFrame functions only.

Each kind's matches are found with one regular expression per kind: the matches are set between control characters,
the text is cut there, and running lengths give the code-point spans. Base kinds (assignments, access identifiers, hex
runs) are always reported. The patterns repeat groups possessively only, so that a run of any length is read without
recursion and once.

Further kinds are weak alone: an ``ident`` (account, user or key id set to a value), a ``key`` (a mixed run of 32 or more
base64 characters) and an ``endpoint`` (a URL with host, or host and port). They are reported only with what complements
them inside one scope, here at most ``SCOPE`` code points apart in the same document: an identifier (ident or access)
needs secret material (key, assign or hex) and the other way round; an endpoint needs both. Parts are joined by
document and by the scope-sized bins that they span, an interval join; before the join, the parts of a class in a bin
are reduced to the first start and the last end, which are all that a neighbouring part can depend on.

Defined results: a null or empty text has no span; very long texts and runs are read whole, and links hold across parts
of any length; the control characters U+0001 and U+0002 count as other characters that no pattern has; repeated rows give
a row each; an empty table gives an empty result; only id and text columns are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCOPE = 300
# The base patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds. A key may follow "=", ":" or a quote and a name may follow "_" or "-", so env files (DB_USER=x) are read.
IDENT = r"""(?i:(?<![\p{L}\p{N}])(?:user(?:name)?|login|account(?:_?(?:id|name))?|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}+)"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{3,}+|(?<![\p{L}\p{N}_-])(?<![a-z0-9-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b)"
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = 3
_OPEN, _CLOSE = "\u0001", "\u0002"


def _pieces(text: str, pattern: str, kept: Callable[[Column], Column]) -> Column:
    """What column ``text`` falls into at a pattern's matches: first what is before them, then each with what follows.

    A piece has its length (n), its match's length (m) and whether the match counts (ok); the text is free of the two
    control characters. Null where nothing matches.
    """
    quoted = F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))

    def piece(p: Column, i: Column) -> Column:
        match = F.substring_index(p, _CLOSE, 1)
        return F.struct((F.length(p) - (i > 0).cast("int")).alias("n"), F.when(i > 0, F.length(match)).otherwise(0).alias("m"), ((i > 0) & kept(match)).alias("ok"))

    return F.when(F.col(text).rlike(pattern), F.transform(F.split(quoted, _OPEN), piece))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(row, id)`` of every document and ``(row, s, k, e)`` of every match, k the kind's place in KINDS."""
    text = F.coalesce(docs[text_col], F.lit(""))
    plain = F.when(text.rlike("[\\x01\\x02]"), F.translate(text, _OPEN + _CLOSE, "\u0003\u0003")).otherwise(text)
    kept: dict[int, Callable[[Column], Column]] = {0: lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, 1: lambda m: F.length(m) >= 20}
    found = [_pieces("t", p, kept.get(k, lambda _: F.lit(True))) for k, p in enumerate((ASSIGN, ACCESS, HEX, IDENT, KEY, ENDPOINT))]
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("pieces")) for k, p in enumerate(found)]), lambda x: x["pieces"].isNotNull())
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), plain.alias("t")).select("row", "id", kinds.alias("kinds")), "pieces")
    each = rows.filter(F.size("kinds") > 0).select("row", F.inline("kinds")).select("row", "k", F.posexplode("pieces").alias("i", "p"))
    before = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("p.n").over(before), F.lit(0)).cast("int")
    spans = each.withColumn("s", start).filter("p.ok").select("row", "s", "k", (F.col("s") + F.col("p.m")).alias("e"))
    return rows.select("row", "id"), spans


def link_credentials(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``spans`` (row, s, k, e) to those of weak kinds that have their complement in scope."""
    # Class 0: identifiers, 1: secret material, 2: endpoints.
    each = spans.withColumn("c", F.get(F.array(*[F.lit(x) for x in (1, 0, 1, 0, 1, 2)]), F.col("k")))
    # A part is in all bins that it spans. A bin at the left border of a part's reach lies left of the part's end and one at the
    # right border right of its start, so the first start and the last end of a bin tell whether any of its parts is in reach.
    spanned = F.sequence(F.floor(F.col("s") / scope).cast("int"), F.floor(F.col("e") / scope).cast("int"))
    edges = each.filter("c < 2").select("row", "s", "e", F.col("c").alias("c2"), F.explode(spanned).alias("bin")).groupBy("row", "bin", "c2").agg(F.min("s").alias("a0"), F.max("e").alias("b1"))
    reach = F.sequence(F.floor((F.col("s") - scope) / scope).cast("int"), F.floor((F.col("e") + scope) / scope).cast("int"))
    looking = each.filter(F.col("k") >= BASE).select("row", "s", "e", "k", "c", F.explode(reach).alias("bin"))
    near = looking.join(edges, ["row", "bin"])
    meets = (F.col("a0") <= F.col("e") + scope) & (F.col("b1") >= F.col("s") - scope)
    met = near.filter(meets & (F.col("c2") != F.col("c"))).groupBy("row", "s", "e", "k", "c").agg(F.max((F.col("c2") == 0).cast("int")).alias("ident"), F.max((F.col("c2") == 1).cast("int")).alias("material"))
    return met.filter("(c = 0 AND material = 1) OR (c = 1 AND ident = 1) OR (c = 2 AND ident = 1 AND material = 1)").select("row", "s", "k", "e")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(id, base, spans)``: a row per document; arrays of ``(s, k, e)`` in order, base kinds alone and all reported."""
    rows, spans = secret_spans(docs, id_col, text_col)
    spans = written(spans, "spans")
    found = spans.filter(F.col("k") < BASE).unionByName(link_credentials(spans, scope))
    listed = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("spans"))
    out = rows.join(listed, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("CAST(array() AS array<struct<s:int,k:int,e:int>>)")))
    return out.select(F.col("id").alias(id_col), F.filter("spans", lambda p: p["k"] < BASE).alias("base"), "spans")
