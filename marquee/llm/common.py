"""Helpers shared by the operators: shared-folder tables, row identities, distributed ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import ensure_checkpoint_dir

#: a side is broadcast only when it was counted and has at most this many rows of a few numbers
BROADCAST_ROWS = 200_000


class Workspace:
    """Intermediate tables of one operator call, in the cluster's shared checkpoint folder.

    A written table cuts the lineage: if an executor is lost later, its tasks read the
    table again. ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marquee-llm/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_written_at", None)
        if path:
            df._written_at = None
            hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table that was counted and is small; beyond the limit Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def identified(ws: Workspace, docs: DataFrame, id_col: str, columns: dict[str, Column]) -> tuple[DataFrame, bool]:
    """Rows with a long ``uid`` that is unique and ordered like ``id_col``.

    Usually ``uid`` is the id itself. If ids repeat, are null or are not whole numbers,
    rows are numbered in order of (id, null first; hash of their columns; place) and the
    numbered table is written, so that the numbers stay the same when tasks run again.
    Returns the table (uid, _id, columns...) and whether it is the written one.
    """
    rows = docs.select(F.col(id_col).alias("_id"), *[c.alias(k) for k, c in columns.items()])
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole:
        n, known, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.countDistinct(id_col)).first()
        if n == known == distinct:
            return rows.select(F.col("_id").cast("long").alias("uid"), "_id", *columns), False
    tie = F.xxhash64(*columns) if columns else F.lit(0)
    ordered = (rows.withColumn("_tie", tie)
               .repartitionByRange(partitions(ws.spark), F.col("_id").asc_nulls_first(), F.col("_tie"))
               .sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_tie"))
               .select(F.monotonically_increasing_id().alias("uid"), "_id", *columns))
    return ws.save(ordered, "rows"), True


def with_ids(out: DataFrame, rows: DataFrame, rekeyed: bool) -> DataFrame:
    """Put the ids back in place of ``uid``: the same number, or looked up in the numbered table."""
    if not rekeyed:
        return out.select(F.col("uid").cast(rows.schema["_id"].dataType).alias("_id"), *[c for c in out.columns if c != "uid"])
    ids = rows.select("uid", "_id")
    return out.join(ids, "uid").select("_id", *[c for c in out.columns if c != "uid"])


def seeded_hex(seed: str, *cols: Column) -> Column:
    """Reproducible shuffle key: md5 of the seed and the columns as text, null as an empty word."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str,
           size: Column | None = None) -> DataFrame:
    """Rank (from 0), or running sum of ``size`` before the row, within each group.

    ``bucket`` must not fall as ``order`` rises. Buckets are counted first; each row then
    needs only its own bucket sorted, so a group of any size is spread over many tasks.
    """
    amount = F.lit(1) if size is None else size
    rows = df.withColumn("_b", bucket).withColumn("_a", amount.cast("long"))
    keys = [*group, "_b"]
    totals = rows.groupBy(*keys).agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    joined = rows.join(offsets, same).drop(*[f"_g{i}" for i in range(len(keys))])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (joined.withColumn(out, F.col("_before") + F.coalesce(F.sum("_a").over(inside), F.lit(0)))
            .drop("_b", "_a", "_before"))
