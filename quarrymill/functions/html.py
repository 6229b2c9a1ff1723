"""HTML and text functions on columns: titles, meta tags, body text, cleaning and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def title(html: Column, limit: int = 200) -> Column:
    return F.substring(strip(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), 1, limit)


def body_text(html: Column, limit: int = 1500) -> Column:
    """The body's text, tags as blanks; the whole page where no body is closed."""
    inner = F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1)
    return F.substring(squeeze(F.regexp_replace(F.when(inner == "", html).otherwise(inner), "<[^>]+>", " ")), 1, limit)


def meta_map(html: Column) -> Column:
    """Meta tags with ``name`` or ``property`` before ``content``, lower-cased names; the last of a name wins."""
    pattern = r"""(?i)<meta\s+(?:property|name)\s*=\s*["']([^"']*)["']\s+content\s*=\s*["']([^"']*)["']"""
    # Backwards, so that the first place of a name is its last tag.
    names = F.reverse(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.lower))
    values = F.reverse(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)))
    keys = F.array_distinct(names)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(values, (F.array_position(names, k) - 1).cast("int"))))


def og_tags(html: Column, limit: int = 200) -> Column:
    return F.transform_values(F.map_filter(meta_map(html), lambda k, v: k.startswith("og:")), lambda k, v: F.substring(v, 1, limit))


def clean_named(html: Column) -> Column:
    """Tags go, named and numeric references become blanks, white space is squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), "&[a-zA-Z]+;|&#[0-9]+;", " "))


def clean_xml_entities(html: Column) -> Column:
    """Tags become blanks and the five entities of XML are decoded (the ampersand last)."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return squeeze(text)


def main_text_fallback(html: Column) -> Column:
    """Text without scripts, styles, navigation, headers, footers and noscript parts."""
    for tag in ("script", "style", "nav", "header", "footer", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def description(html: Column, limit: int = 500) -> Column:
    """Scripts and styles go; text over the limit is cut and marked."""
    text = squeeze(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " "))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def label(text: Column, limit: int = 80) -> Column:
    """A navigation label without style rules and declarations that leaked into it."""
    rules = F.regexp_replace(text, r"[.#]?[a-zA-Z_-][\w-]*\s*\{[^}]*\}", " ")
    return F.substring(squeeze(F.regexp_replace(rules, r"[a-z-]+\s*:\s*[^;{}]+;", " ")), 1, limit)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def first_integer(text: Column) -> Column:
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("long")


def rating(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)rating value is ([0-9.]+) of", 1).try_cast("double")


def style_id(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)style(?:\s*(?:id|no|number))?\s*[:#]\s*([A-Za-z0-9_-]+)", 1)


def title_head(text: Column) -> Column:
    return F.substring_index(text, " | ", 1)


def paragraphs(html: Column) -> Column:
    """Paragraph texts, blank ones dropped, joined by newlines."""
    inner = F.regexp_extract_all(html, F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.array_join(F.filter(F.transform(inner, lambda x: squeeze(F.regexp_replace(x, "<[^>]+>", " "))), lambda x: x != ""), "\n")


def frontmatter(markdown: Column, field: str) -> Column:
    return strip(F.regexp_extract(markdown, rf"(?m)^{field}:[ \t]*(.*)$", 1))


def shorten(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


# The named selectors that pages are tested for, as the tag or attribute that they ask for.
SELECTORS = {
    "h1": r"<h1[\s>]", "price": r"""class\s*=\s*["'][^"']*\bprice\b""", "title": "<title[^>]*>", "nav": r"<nav[\s>]", "article": r"<article[\s>]", "footer": r"<footer[\s>]",
    "image": r"<img\s", "form": r"<form[\s>]", "breadcrumb": r"""class\s*=\s*["'][^"']*breadcrumb""", "sku": r"""itemprop\s*=\s*["']sku["']""", "main": r"<main[\s>]", "ad": r"""class\s*=\s*["'][^"']*\bad\b""",
}


def selector_counts(html: Column) -> dict[str, Column]:
    return {name: F.regexp_count(html, F.lit("(?i)" + pattern)) for name, pattern in SELECTORS.items()}


def title_before(text: Column, brand: str) -> Column:
    """A title up to the brand, else up to the first bar or long dash."""
    said = F.coalesce(text, F.lit(""))
    at = F.locate(f" {brand}", said)
    return strip(F.when(at > 0, F.substring(said, F.lit(1), at - 1)).otherwise(F.substring_index(F.substring_index(said, "|", 1), "\u2014", 1)))
