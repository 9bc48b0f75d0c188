"""Mining that goes on: templates of a new batch against those of the batches before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from . import mining

FOREST = ["template_id", "parent_id", "action", "block", "instances", *mining.SIDES, "places"]


def started(templates: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(distinct templates, their forest with blocks): what ``grown`` goes on from."""
    known = materialise(mining.distinct_templates(templates), "distinct")
    return known, mining.mine_distinct(known, **how).select(*FOREST)


def grown(known: DataFrame, forest: DataFrame, templates: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The two tables of ``started`` after more templates: the same as from all of them at once, but for lines.

    New templates meet known ones by their digest. A block in which all are
    known keeps its trees, since these do not depend on numbers of instances:
    the new instances are added to a template and to all above it, a level a
    round. Only blocks with a template that is new are mined again, from their
    distinct templates; blocks cannot affect each other. Trees that are kept
    keep the lines of the templates they were made of. An empty batch changes
    nothing.
    """
    fresh = materialise(mining.distinct_templates(templates), "fresh")
    block = ["action", "block"]
    changed = materialise(fresh.join(known.select("id"), "id", "left_anti").select(*block).distinct(), "changed")
    every = materialise(united(known, fresh), "distinct")
    kept = forest.join(changed, block, "left_anti").select(*FOREST)
    more = instances_above(kept, fresh.join(changed, block, "left_anti").select(F.col("id").alias("template_id"), F.col("instances").alias("more")))
    kept = kept.join(more, "template_id", "left").withColumn("instances", F.col("instances") + F.coalesce("more", F.lit(0))).select(*FOREST)
    if changed.isEmpty():
        return every, kept
    again = mining.mine_distinct(every.join(changed, block, "left_semi"), **how).select(*FOREST)
    return every, kept.unionByName(again)


def united(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two tables of distinct templates as one: instances add up, and what equal ones may differ in (lines) is the least, as in one batch."""
    rest = [c for c in mining.COLUMNS if c not in ("id", "instances")]
    return known.unionByName(fresh).groupBy("id").agg(F.sum("instances").alias("instances"), *[F.min(c).alias(c) for c in rest]).select(*mining.COLUMNS)


def instances_above(forest: DataFrame, counts: DataFrame) -> DataFrame:
    """(template_id, more): counts of templates, added to those of all above them; a level of the forest a round."""
    up = forest.where("parent_id is not null").select("template_id", "parent_id")
    level = materialise(counts, "counts")
    total = level
    while not level.isEmpty():
        level = materialise(level.join(up, "template_id").groupBy(F.col("parent_id").alias("template_id")).agg(F.sum("more").alias("more")), "counts")
        total = total.unionByName(level)
    return total.groupBy("template_id").agg(F.sum("more").alias("more"))


def follow(templates: DataFrame, state: str, checkpoint: str, **how):
    """Grows the forest in the folder ``state`` by each batch of a stream of templates, and ends when none is left.

    A batch reads the version of the one before it and writes its own, so one
    that is run again after a failure replaces what it wrote and counts nothing
    twice. Versions before the last two are emptied.
    """
    names = ("distinct", "forest")
    place = lambda name, number: f"{state}/{name}/version={number}"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = [spark.read.parquet(place(name, number - 1)) for name in names] if number else None
        for name, made in zip(names, grown(*old, batch, **how) if old else started(batch, **how), strict=True):
            made.write.mode("overwrite").parquet(place(name, number))
            if number > 1:
                spark.createDataFrame([], made.schema).write.mode("overwrite").parquet(place(name, number - 2))

    query = templates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def newest(spark: SparkSession, state: str) -> DataFrame:
    """The forest after the last batch that ``follow`` has written whole."""
    forest = spark.read.parquet(f"{state}/forest")
    last = forest.agg(F.max("version").alias("version"))
    return forest.join(F.broadcast(last), "version").drop("version", "block")  # one number
