"""Threads from posts with parents: depth, reading order and nested replies, for any depth, and what has no place in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.shared import kept

#: Digits of a post's place among all of its thread, by which paths sort as text.
_DIGITS = 10


def placed_posts(posts: DataFrame, order: str = "post") -> DataFrame:
    """``posts`` (thread, post, parent, ...) with ``depth``, ``path`` and ``problem``.

    Every post looks twice as far up in each round (pointer doubling), so that the rounds grow with the logarithm of the
    depth; a round is written and the next reads it. ``path`` has the places of all posts from the first down to this
    one and sorts as the thread reads. ``problem`` is ``cycle`` where no first post is ever reached (depth and path are null then),
    ``orphan`` where the parent isn't in the thread, which makes the post a first one, else empty. Ids are expected once a thread.
    """
    own = F.lpad(F.col(order).cast("string"), _DIGITS, "0")
    ids = posts.select("thread", F.col("post").alias("parent")).withColumn("there", F.lit(True))
    start = posts.select("thread", "post", "parent", own.alias("path")).join(ids, ["thread", "parent"], "left")
    orphan = F.col("parent").isNotNull() & F.col("there").isNull()
    now = kept(start.select("thread", "post", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(0).cast("long").alias("depth"), "path", F.when(orphan, "orphan").otherwise("").alias("problem")), "posts")
    # A post that has looked past the first one looks no further; those that still look after so many rounds go round.
    most = posts.groupBy("thread").count().agg(F.max("count")).head()[0] or 0
    seen = 1
    while True:
        above = now.select("thread", F.col("post").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"))
        step = now.join(above, ["thread", "up"], "left")
        met = F.col("up").isNotNull()
        deeper = F.col("depth") + F.when(met, F.col("more") + 1).otherwise(0)
        longer = F.when(met, F.concat("before", "path")).otherwise(F.col("path"))
        now = kept(step.select("thread", "post", F.col("next").alias("up"), deeper.alias("depth"), longer.alias("path"), "problem"), "posts")
        seen *= 2
        if seen > most or now.filter("up IS NOT NULL").isEmpty():
            break
    lost = F.col("up").isNotNull()
    done = now.select("thread", "post", F.when(~lost, F.col("depth")).alias("depth"), F.when(~lost, F.col("path")).alias("path"), F.when(lost, "cycle").otherwise(F.col("problem")).alias("problem"))
    return posts.join(done, ["thread", "post"])


def nested_threads(placed: DataFrame, post: Column) -> DataFrame:
    """``(thread, posts, replies, deepest, tree)``: a row per thread; ``tree`` is JSON, posts with their ``replies`` nested in reading order.

    ``post`` is a struct of what to show of a post. Posts in cycles have no place and are left out. Brackets follow from the
    depths of a post and of the next one, so that no level is put together on its own.
    """
    order = Window.partitionBy("thread").orderBy("path")
    after = F.coalesce(F.lead("depth").over(order), F.lit(-1))
    shown = F.to_json(post)
    opened = F.concat(F.expr("substring(shown, 1, length(shown) - 1)"), F.when(F.length("shown") > 2, ",").otherwise(""), F.lit('"replies":['))
    ends = F.when(F.col("after") < 0, F.col("depth") + 1).otherwise(F.greatest(F.col("depth") - F.col("after") + 1, F.lit(0)))
    goes_on = (F.col("after") >= 0) & (F.col("after") <= F.col("depth"))
    text = F.concat(opened, F.repeat(F.lit("]}"), ends.cast("int")), F.when(goes_on, ",").otherwise(""))
    rows = placed.filter("path IS NOT NULL").select("thread", "path", "depth", shown.alias("shown"), after.alias("after")).select("thread", "path", "depth", text.alias("part"))
    whole = rows.groupBy("thread").agg(F.count("*").alias("posts"), F.max("depth").alias("deepest"), F.array_sort(F.collect_list(F.struct("path", "part"))).alias("parts"))
    tree = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit("]"))
    return whole.select("thread", "posts", F.greatest(F.col("posts") - 1, F.lit(0)).alias("replies"), "deepest", tree.alias("tree"))
