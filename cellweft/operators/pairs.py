"""Pairs of items of one basket, without a self-join and without a task that meets a whole huge basket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A basket of more items than this is paired block by block, each two blocks a row of their own.
BLOCK_ITEMS = 256


def basket_pairs(members: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(left, right, n): in how many baskets each unordered pair of distinct items is, left < right.

    ``members``: basket, item, distinct and not null. Items of a basket gather in blocks of about ``block_items`` by hash; pairs inside
    a block come from its row, pairs of two blocks from joining the blocks of a large basket, so one shuffle on (basket, block)
    moves each item once. An empty input gives no rows.
    """
    sizes = members.groupBy("basket").agg(F.ceil(F.count("*") / block_items).cast("int").alias("nb")).where("nb > 1")
    m = members.join(sizes, "basket", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    # Lists are bounded: blocks are cut by size.
    blocks = m.groupBy("basket", "nb", F.pmod(F.hash("item"), F.col("nb")).alias("block")).agg(F.collect_list("item").alias("items"))
    inside = blocks.where(F.size("items") > 1).select("items", F.explode("items").alias("left")).select(
        "left", F.explode(F.filter("items", lambda x: x > F.col("left"))).alias("right"))
    many = blocks.where("nb > 1")
    a = many.select("basket", F.col("block").alias("i"), F.col("items").alias("a"))
    b = many.select("basket", F.col("block").alias("j"), F.col("items").alias("b"))
    across = a.join(b, "basket").where("i < j").select("b", F.explode("a").alias("x")).select("x", F.explode("b").alias("y")).select(
        F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))
    return inside.unionByName(across).groupBy("left", "right").agg(F.count("*").alias("n"))
