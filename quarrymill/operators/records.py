"""Record builders: one typed record per page or source row, with the documented order of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import jsonld as J
from quarrymill.functions import normalize as N
from quarrymill.shared import fresh_path


def product(block: Column) -> dict[str, Column]:
    """A product from its JSON-LD block; the original price counts only above the price."""
    offer = J.offer(block)
    price = F.coalesce(J.text(offer, "$.price"), F.lit(""))
    return {
        "title": J.either(block, "$.name"),
        "price": price,
        "original_price": F.coalesce(N.original_price(J.text(offer, "$.highPrice"), price), F.lit("")),
        "currency": F.coalesce(J.text(offer, "$.priceCurrency"), F.lit("USD")),
        "availability": N.availability_basic(J.text(offer, "$.availability")),
        "brand": N.brand(J.named(block, "brand")),
        "sku": J.either(block, "$.sku"),
    }


def shop_product(v: Column, site: str) -> dict[str, Column]:
    """A product from a shop system's JSON: its first variant decides."""
    price, compare = (F.coalesce(J.text(v, f"$.variants[0].{k}"), F.lit("")) for k in ("price", "compare_at_price"))
    return {
        "title": J.either(v, "$.title"),
        "price": F.when(price == "", "").otherwise(F.concat(F.lit("$"), price)),
        "availability": F.when(F.coalesce(F.try_variant_get(v, "$.variants[0].available", "boolean"), F.lit(False)), "In Stock").otherwise("Out of Stock"),
        "original_price": F.when((compare == "") | (compare == price), "").otherwise(F.concat(F.lit("$"), compare)),
        "url": F.concat(F.lit(f"{site}/products/"), J.either(v, "$.handle")),
    }


def api_product(v: Column) -> dict[str, Column]:
    return {"title": J.either(v, "$.title", "$.name"), "price": J.either(v, "$.price"), "original_price": J.either(v, "$.original_price", "$.compare_at_price", "$.highPrice")}


def article(v: Column) -> dict[str, Column]:
    return {
        "title": F.coalesce(J.text(v, "$.headline"), J.text(v, "$.name"), F.lit("")),
        "author": J.named(v, "author"),
        "publish_date": J.either(v, "$.datePublished"),
        "content": J.either(v, "$.articleBody"),
        "images": F.array_join(J.pictures(v), " "),
        "tags": F.array_join(J.keywords(v), "|"),
        "category": J.either(v, "$.articleSection"),
    }


def job(v: Column) -> dict[str, Column]:
    return {
        "title": J.either(v, "$.title"),
        "company": J.named(v, "hiringOrganization"),
        "location": J.location(v),
        "salary": J.salary(v),
        "description": J.either(v, "$.description"),
        "requirements": J.listed_or_text(v, "qualifications", "\n"),
        "job_type": J.listed_or_text(v, "employmentType", ", "),
    }


def thread(v: Column) -> dict[str, Column]:
    """A forum thread; every post but the first is a reply."""
    posts = F.coalesce(J.elements(v, "$.comment"), F.array().cast("array<variant>"))
    return {
        "title": J.either(v, "$.headline", "$.name", "$.title"),
        "author": J.named(v, "author"),
        "posts": F.size(posts).cast("long"),
        "replies": F.greatest(F.lit(0), F.size(posts) - 1).cast("long"),
        "last_activity": F.coalesce(F.array_max(F.transform(posts, lambda p: J.text(p, "$.dateCreated"))), F.lit("")),
    }


def error_record(url: Column, error: Column) -> dict[str, Column]:
    """A failed page keeps its place with empty fields, status 0 and the reason."""
    return {"title": F.lit(""), "price": F.lit(""), "url": url, "status_code": F.lit(0).cast("long"), "remarks": F.substring(F.concat(F.lit("Error: "), error), 1, 200)}


def require_title(records: DataFrame) -> DataFrame:
    """A record without a title loses its status and says so."""
    missing = F.coalesce("title", F.lit("")) == ""
    return records.withColumns(
        {
            "remarks": F.when(missing, F.concat_ws("; ", F.nullif("remarks", F.lit("")), F.lit("No title found"))).otherwise(F.col("remarks")),
            "status_code": F.when(missing, F.lit(0).cast("long")).otherwise(F.col("status_code")),
        }
    )


def warned(price: Column, currency: Column, availability: Column) -> Column:
    """The warnings that go into remarks where a default stands in for a value."""
    parts = F.array(F.when(price == "", "price missing"), F.when(currency == "", "currency defaulted"), F.when(availability == "", "availability defaulted"))
    return F.array_join(F.array_compact(parts), "; ")


def number_rows(records: DataFrame, order: str) -> DataFrame:
    """``id`` from 1 on in the order of an explicit column.

    Rows are ordered in ranges and written; ranges are counted, so that a row's number is the count before its range
    and its place in it, and no single task sees all rows.
    """
    path = fresh_path(records.sparkSession, "numbered")
    records.orderBy(order).select(F.struct("*").alias("row"), F.spark_partition_id().alias("part")).write.parquet(path)
    rows = records.sparkSession.read.parquet(path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("ahead"))  # a row per range
    place = F.row_number().over(Window.partitionBy("part").orderBy(f"row.{order}"))
    return rows.withColumn("place", place).join(F.broadcast(ahead), "part").select("row.*", (F.col("ahead") + F.col("place")).cast("long").alias("id"))


def merge_fields(direct: Column, existing: Column, mapped: Column) -> Column:
    """Field maps: direct values, overridden by valid existing ones, filled up by valid mapped ones."""

    def valid(m: Column) -> Column:
        return F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")

    base = F.map_concat(F.map_filter(direct, lambda k, v: ~F.map_contains_key(valid(existing), k)), valid(existing))
    return F.map_concat(base, F.map_filter(valid(mapped), lambda k, v: ~F.map_contains_key(base, k)))


def page_record(v: Column, title: Column, body: Column, metadata: Column) -> dict[str, Column]:
    """A generic page: texts of its JSON-LD where there is a block, else its own title and body; pictures by JSON-LD, meta tags as they are."""
    there = v.isNotNull()
    return {
        "title": F.when(there, J.either(v, "$.headline", "$.name")).otherwise(F.coalesce(title, F.lit(""))),
        "content": F.when(there, J.either(v, "$.articleBody", "$.description")).otherwise(F.coalesce(body, F.lit(""))),
        "images": F.coalesce(J.pictures(v), F.array().cast("array<string>")),
        "metadata": F.coalesce(metadata, F.create_map().cast("map<string,string>")),
    }


def item_record(v: Column, content_type: str, heading: Column, currency: str = "USD") -> dict[str, Column]:
    """An item found by navigation, of one of three types; the page's heading where JSON-LD has no title."""
    if content_type == "article":
        own = {"title": J.either(v, "$.headline", "$.name"), "author": J.either(v, "$.author.name", "$.author[0].name"), "publish_date": J.either(v, "$.datePublished"), "content": J.either(v, "$.articleBody")}
    elif content_type == "job_posting":
        own = {"title": J.either(v, "$.title"), "company": J.either(v, "$.hiringOrganization.name"), "location": J.either(v, "$.jobLocation.address.addressLocality"), "description": J.either(v, "$.description")}
    else:
        offer, price = J.offer(v), F.coalesce(J.text(J.offer(v), "$.price"), F.lit(""))
        code = F.coalesce(J.text(offer, "$.priceCurrency"), F.lit(currency))
        sold = F.coalesce(J.text(offer, "$.availability"), F.lit("")).rlike("OutOfStock|SoldOut")
        own = {"title": J.either(v, "$.name"), "price": F.when(price == "", "").otherwise(F.concat(code, price)), "currency": code, "availability": F.when(sold, "Out of Stock").otherwise("In Stock"), "description": J.either(v, "$.description")}
    own["title"] = F.coalesce(F.nullif(own["title"], F.lit("")), heading, F.lit(""))
    return own


def sparse_json(always: dict[str, Column], optional: dict[str, Column]) -> Column:
    """A record as JSON: the first fields whatever they hold, the optional ones only if they aren't empty."""
    shown = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in always.items()]
    return F.to_json(F.struct(*shown, *[F.nullif(c, F.lit("")).alias(n) for n, c in optional.items()]))
