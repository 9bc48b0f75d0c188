"""Exact containment of short texts in long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

#: Items of fewer than three words that are searched for in one pass.
SHORT_ITEMS = 1000


def containing(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, hits): documents that contain items' texts: the least such item, and how many.

    A word inside an item, neither its first nor its last, stands whole in any
    text that contains it. Items are keyed by their longest inner word,
    documents list their distinct words without their texts, an equi-join
    brings the two together, and the text is taken back for the whole item to
    be searched for. Items without an inner word are searched for in every
    text, some SHORT_ITEMS a pass. Ids are of any type.

    Null and empty items occur in nothing; null documents contain nothing.
    """
    words = lambda c: F.split(F.col(c), "[ \t\r\n]+")
    known = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("item")).where("item is not null and item <> ''").withColumn("inner", words("item")).withColumn("inner", F.when(F.size("inner") > 2, F.slice("inner", F.lit(2), F.size("inner") - 2)))
    keyed = known.where("inner is not null").select("item_id", "item", F.array_max(F.transform("inner", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"].alias("word"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    named = texts.withColumn("text_id", F.xxhash64("text"))
    maybe = named.select("doc_id", "text_id", F.explode(F.array_distinct(words("text"))).alias("word")).join(keyed, "word").select(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text"), "item_id", "item").distinct()
    met = named.join(maybe, named["doc_id"].eqNullSafe(maybe["__doc"]) & (named["text_id"] == maybe["__text"])).where(F.contains("text", "item")).select("doc_id", "item_id")
    short = materialise(known.where("inner is null").select("item_id", "item"), "short")
    passes = -(-short.count() // SHORT_ITEMS)
    for k in range(passes):
        listed = short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(passes)) == k).agg(F.collect_list(F.struct("item_id", "item")).alias("listed"))  # one row of some SHORT_ITEMS items
        hits = F.filter("listed", lambda x: F.contains(F.col("text"), x["item"]))
        met = met.unionByName(texts.join(F.broadcast(listed)).select("doc_id", F.explode(hits).alias("hit")).select("doc_id", F.col("hit.item_id").alias("item_id")))
    return met.groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("hits"))
