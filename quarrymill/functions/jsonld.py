"""JSON-LD on columns: blocks of a page as VARIANT, typed lookups, prices, people, pictures, breadcrumbs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def text(v: Column, path: str) -> Column:
    """A scalar at ``path`` as text; null for objects, lists and null."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(~F.coalesce(kind, F.lit("VOID")).rlike("^(?:OBJECT|ARRAY|VOID)"), F.try_variant_get(v, path, "string"))


def elements(v: Column, path: str = "$") -> Column:
    """The elements of a list at ``path``; null where there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT")


def blocks(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``(keep..., script_pos, item_pos, block)``: every JSON-LD object; lists are taken apart, invalid scripts skipped."""
    scripts = pages.select(*keep, F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("script_pos", "raw"))
    parsed = scripts.withColumn("v", F.try_parse_json(F.regexp_replace("raw", r"^\s+|\s+$", ""))).filter("v IS NOT NULL")
    items = F.coalesce(elements(F.col("v")), F.array("v"))
    return parsed.select(*keep, "script_pos", F.posexplode(items).alias("item_pos", "block")).filter(is_object(F.col("block")))


def types(v: Column) -> Column:
    """The block's types as an array of text, whether it names one or a list."""
    return F.coalesce(F.try_variant_get(v, '$["@type"]', "array<string>"), F.array_compact(F.array(text(v, '$["@type"]'))))


def first_of_type(blocks_: DataFrame, wanted: Sequence[str], by: str = "page_id") -> DataFrame:
    """The first block of a wanted type in document order."""
    hits = blocks_.filter(F.arrays_overlap(types(F.col("block")), F.array(*map(F.lit, wanted))))
    return hits.groupBy(by).agg(F.min_by("block", F.struct("script_pos", "item_pos")).alias("block"))


def offer(v: Column) -> Column:
    """The offers object, or the first object of an offers list."""
    whole = F.try_variant_get(v, "$.offers", "variant")
    return F.when(is_object(whole), whole).otherwise(F.get(F.filter(elements(v, "$.offers"), is_object), F.lit(0)))


def truthy(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("")).isin("", "0", "0.0", "false")


def has_price(v: Column) -> Column:
    whole = F.try_variant_get(v, "$.offers", "variant")
    listed = F.exists(elements(v, "$.offers"), lambda o: truthy(F.try_variant_get(o, "$.price", "string")))
    return F.coalesce(F.when(is_object(whole), truthy(text(v, "$.offers.price"))).otherwise(listed), F.lit(False))


def either(v: Column, *paths: str) -> Column:
    """The first path with non-empty text, else empty."""
    return F.coalesce(*[F.nullif(text(v, p), F.lit("")) for p in paths], F.lit(""))


def named(v: Column, key: str) -> Column:
    """A person or organisation: the text itself, an object's name, or the first of a list."""
    return either(v, f"$.{key}", f"$.{key}.name", f"$.{key}[0]", f"$.{key}[0].name")


def pictures(v: Column, key: str = "image") -> Column:
    """Picture URLs from text, a list of texts or a list of objects."""
    listed = F.transform(elements(v, f"$.{key}"), lambda x: F.coalesce(text(x, "$"), text(x, "$.url")))
    return F.filter(F.coalesce(listed, F.array_compact(F.array(F.coalesce(text(v, f"$.{key}"), text(v, f"$.{key}.url"))))), lambda u: F.coalesce(u, F.lit("")) != "")


def keywords(v: Column, key: str = "keywords") -> Column:
    split = F.filter(F.transform(F.split(text(v, f"$.{key}"), ","), lambda k: F.trim(k)), lambda k: k != "")
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), split, F.array().cast("array<string>"))


def listed_or_text(v: Column, key: str, separator: str) -> Column:
    return F.coalesce(text(v, f"$.{key}"), F.array_join(F.try_variant_get(v, f"$.{key}", "array<string>"), separator), F.lit(""))


def salary(v: Column) -> Column:
    low, high, unit = (F.coalesce(text(v, f"$.baseSalary.value.{k}"), F.lit("")) for k in ("minValue", "maxValue", "unitText"))
    return F.when((low != "") & (high != ""), F.concat(F.lit("$"), low, F.lit(" - $"), high, F.lit(" "), unit)).when(low != "", F.concat(F.lit("$"), low, F.lit(" "), unit)).otherwise("")


def location(v: Column) -> Column:
    parts = [text(v, f"$.jobLocation.address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")]
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), ", ")


def breadcrumb(v: Column, separator: str = " > ", drop: Sequence[str] = ("Home", "Home page")) -> Column:
    """Names of a breadcrumb list whose elements hold an item with a name, a name, or an item as text."""
    names = F.transform(elements(v, "$.itemListElement"), lambda e: either(e, "$.item.name", "$.name", "$.item"))
    return F.array_join(F.filter(names, lambda n: (n != "") & ~n.isin(*drop)), separator)


def longest_tag(tags: Column, prefix: str = "cat:") -> Column:
    """Of the tags with the prefix the longest, the first on ties."""
    own = F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.coalesce(F.array_min(own)["t"], F.lit(""))


def summary(v: Column, keys: int = 15) -> Column:
    fields = F.array_join(F.slice(F.json_object_keys(F.to_json(v)), 1, keys), ", ")
    return F.concat_ws(" / ", F.array_join(types(v), ","), fields, F.when(has_price(v), "offers with price").otherwise("no price"))


def any_case(v: Column, *names: str) -> Column:
    """The text at a path whose keys are written with a capital or without: at each step the capitalised one first, if it isn't empty."""
    paths = ["$"]
    for n in names:
        paths = [f"{p}.{k}" for p in paths for k in (n[:1].upper() + n[1:], n)]
    return F.coalesce(*[F.nullif(text(v, p), F.lit("")) for p in paths], F.lit(""))


def wrapped_blocks(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``(keep..., product, rating, review)``: a page's first product, and its first rating and review, in an object of that key or by type.

    Only the first object of a block counts: a product, else a rating's or review's key, else the type. Pages without blocks
    have no row. All is done within the page's row: nothing is sorted, grouped or shuffled.
    """
    parsed = F.transform(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)), lambda raw: F.try_parse_json(F.regexp_replace(raw, r"^\s+|\s+$", "")))
    items = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: F.coalesce(elements(v), F.array(v))))
    keys = ("aggregateRating", "review")

    def facts(v: Column) -> Column:
        return F.struct(F.coalesce(text(v, '$["@type"]'), F.lit("")).alias("kind"), *[F.try_variant_get(v, f"$.{k}", "variant").alias(k) for k in keys], v.alias("own"))

    def role(x: Column) -> Column:
        kind = x["kind"]
        r = F.when(kind == "Product", "product").when(x["aggregateRating"].isNotNull(), "rating").when(x["review"].isNotNull(), "review").when(kind == "AggregateRating", "rating").when(kind == "Review", "review")
        return F.struct(r.alias("role"), x.alias("of"))

    def value(y: Column) -> Column:
        x = y["of"]
        v = F.when(y["role"] == "rating", F.coalesce(x["aggregateRating"], x["own"])).when(y["role"] == "review", F.coalesce(x["review"], x["own"])).otherwise(x["own"])
        return F.struct(y["role"].alias("role"), v.alias("value"))

    each = F.transform(F.transform(F.transform(F.filter(items, is_object), facts), role), value)
    good = F.filter(each, lambda x: is_object(x["value"]))

    def first(found: Column, r: str) -> Column:
        return F.get(F.filter(found, lambda x: x["role"] == r), F.lit(0))["value"].alias(r)

    firsts = F.transform(F.filter(F.array(good), lambda found: F.size(found) > 0), lambda found: F.struct(*[first(found, r) for r in ("product", "rating", "review")]))
    return pages.select(*keep, F.inline(firsts))


def category_path(v: Column, key: str = "category") -> Column:
    """A category, or the names of a list of them that aren't empty, by ``" > "``."""
    listed = F.transform(elements(v, f"$.{key}"), lambda x: F.coalesce(text(x, "$"), F.lit("")))
    return F.coalesce(F.array_join(F.filter(listed, truthy), " > "), text(v, f"$.{key}"), F.lit(""))


def variant_of(v: Column, wanted: Column) -> Column:
    """The variant with the wanted id, else the first; null without any."""
    all_of = elements(v, "$.variants")
    return F.coalesce(F.get(F.filter(all_of, lambda x: text(x, "$.id") == wanted), F.lit(0)), F.get(all_of, F.lit(0)))


def first_items(v: Column, own: str, keys: Sequence[str] = ("products", "articles", "jobs", "threads", "results", "pages")) -> Column:
    """The items under a document's own key, else under the first of the known ones that has any; null without."""
    return F.coalesce(*[F.when(F.size(elements(v, f"$.{k}")) > 0, elements(v, f"$.{k}")) for k in (own, *keys)])
