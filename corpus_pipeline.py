"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mixing, sharding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything that its
predecessor kept. ``run`` writes each stage's rows to the shared folder and reads them again
as the next one's input, which also cuts the lineage.

Rows that repeat an id are rows of their own throughout; a null text is an empty one; very long
texts are judged and carried whole; an empty table passes every stage empty. Extra columns are
carried, whatever their names; only ``shard`` and ``slot``, which the last stage adds, replace such
columns. What a stage does with rows without text or source is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from marquee.llm.common import Workspace, identified, read_table


def _rows(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """(uid, _row, doc_id, text, source): every row with a number of its own and all its columns."""
    rows, _ = identified(Workspace(spark, f"pipeline-{name}"), docs, "doc_id",
                         {"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    # the texts are in the row already; a second copy would be shuffled and written with it
    return rows.select("uid", "_row", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "text", "source")])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half; a null or empty text is scored as one without terms."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = docs.select(row, toxicity.score_column(model, F.col("text")).alias("_s"))
    return scored.filter(F.col("_s.score") < 0.5).select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates: five words, similarity of 0.8 or more.

    Null and empty texts are like no other and all stay.
    """
    rows = _rows(spark, docs, "near")
    groups = jaccard_join.jaccard_groups(rows.select("uid", "text"), id_col="uid", width=5, num=4, den=5)
    first = groups.filter("_id = component_id").select(F.col("_id").alias("uid"))
    return rows.select("uid", "_row").join(first, "uid", "left_semi").select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth; null and empty texts stay."""
    rows = _rows(spark, docs, "decontaminate")
    verdict, _, _ = decontamination.decontaminate(rows.select("uid", "text"), read_table(spark, sf_dir, "benchmark"), id_col="uid")
    bad = verdict.filter("contaminated").select("uid")
    return rows.select("uid", "_row").join(bad, "uid", "left_anti").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix plays them; one that it plays in part comes whole, one without words once.

    A null source is a source, the last in order.
    """
    rows = _rows(spark, docs, "mix")
    taken, _ = mixing.mix(rows.select("uid", "source", "text"), id_col="uid", keep=["uid"])
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("(taken + size - 1) div size"))
    times = taken.select("uid", times.cast("int").alias("_times")).filter("_times > 0")
    copies = rows.select("uid", "_row").join(times, "uid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in eight shards that each match the mixture; a null source is a stratum.

    Rows are shuffled by their own numbers, so that rows which repeat (the mix plays some
    more than once) have one order, also when a task runs again.
    """
    rows = _rows(spark, docs, "shard")
    placed = sharding.shard(rows.select("uid", "source", "text"), 8, id_col="uid", keep=["uid"])
    placed = placed.select("uid", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    keep = [f"_row.`{c}`" for c in docs.columns if c not in ("shard", "slot")]
    return (rows.select("uid", "_row").join(placed, "uid")
            .select(*keep, F.col("_shard").alias("shard"), F.col("_slot").alias("slot")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: the toxicity model is learnt, which SQL does not express; tests compare the other stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(docs)
        docs = kept
    return docs
