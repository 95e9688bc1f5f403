"""Ranking, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.session import save_table


def pct_rank_avg(value: Column, partition_by: list | None = None) -> Column:
    """pandas ``rank(pct=True)``: average rank of ties divided by the non-null count.

    Nulls get null.  A window expression: each group is sorted by one task, so use it for
    groups of bounded size; ``pct_rank_by`` and ``pct_rank_global`` take groups of any size.
    """
    parts = partition_by or []
    w = Window.partitionBy(*parts)
    rank = F.rank().over(w.orderBy(value.asc_nulls_last()))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*parts, value))
    n = F.count(value).over(w)
    return F.when(value.isNotNull(), (rank + (peers - 1) / 2.0) / n)


def in_ranges(hist: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``hist`` written in ranges of ``columns``, each row with its range's number ``_b``.

    As many ranges as shuffle partitions unless given; Spark samples the cut points and
    places rows by binary search. Ranges only decide how the work is split.
    """
    buckets = buckets or max(2, int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return save_table(hist.repartitionByRange(buckets, *columns).withColumn("_b", F.spark_partition_id()), "ranges")


def running_total(hist: DataFrame, value: str, weight: str, out: str, buckets: int | None = None,
                  by: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Cumulative ``weight`` over ascending ``value`` (ties included) for a table of
    distinct values (optionally per group ``by``), without a window over a whole group.

    The table is written in ranges of (group, value); totals per group and range, at most
    groups + ranges rows, give each range its offset, and the running sum inside a range is
    a window partitioned by (group, range). ``total`` names a column for the group's sum.
    """
    by = list(by or [])
    h = in_ranges(hist, [*by, value], buckets)
    every = Window.partitionBy(*by)
    before = F.sum("_bt").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    offsets = (h.groupBy(*by, "_b").agg(F.sum(weight).alias("_bt"))
               .select(*keys, F.col("_b").alias("_gb"), F.coalesce(before, F.lit(0)).alias("_off"), F.sum("_bt").over(every).alias("_all")))
    same = F.col("_b") == F.col("_gb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    run = F.sum(weight).over(Window.partitionBy(*by, "_b").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    done = h.join(offsets, same).withColumn(out, run + F.col("_off"))
    if total:
        done = done.withColumn(total, F.col("_all"))
    return done.select(*hist.columns, out, *([total] if total else []))


def pct_rank_by(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Average-tie percentile rank of ``value`` within each group ``by`` (no group: the whole table).

    Histogram of distinct values -> running totals (``running_total``) -> join back, so no task
    holds a group's rows. Null and NaN get null."""
    kind = df.schema[value].dataType.typeName()
    known = F.col(value).isNotNull() & (~F.isnan(value) if kind in ("double", "float") else F.lit(True))
    hist = df.where(known).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_peers"))
    ranks = running_total(hist, value, "_peers", "_le", by=by, total="_n")
    ranks = ranks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])],
                         ((F.col("_le") - (F.col("_peers") - 1) / 2.0) / F.col("_n")).alias(out))
    same = F.col(value) == F.col(f"_k{len(by)}")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ranks, same, "left").select(*df.columns, out)


def pct_rank_global(df: DataFrame, value: str, out: str) -> DataFrame:
    """``pct_rank_by`` over the whole table."""
    return pct_rank_by(df, value, [], out)


def popularity_blend(df: DataFrame, pv_col: str = "pv_30d", votes_col: str = "numVotes") -> DataFrame:
    """0.6 * pct(pv) + 0.4 * pct(votes), nulls as 0; no-op if either column is missing."""
    if pv_col not in df.columns or votes_col not in df.columns:
        return df
    tmp = df.withColumns({"_pv0": F.coalesce(F.col(pv_col).cast("double"), F.lit(0.0)),
                          "_v0": F.coalesce(F.col(votes_col).cast("double"), F.lit(0.0))})
    tmp = save_table(tmp, "blended")        # both ranks read it twice
    tmp = pct_rank_global(tmp, "_pv0", "_r_pv")
    tmp = pct_rank_global(tmp, "_v0", "_r_v")
    return tmp.withColumn("popularity_blend", F.col("_r_pv") * 0.6 + F.col("_r_v") * 0.4).drop(
        "_pv0", "_v0", "_r_pv", "_r_v")


def topk(df: DataFrame, n: int, order: list) -> DataFrame:
    """Sort + head (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, n: int = 10, order: list | None = None) -> DataFrame:
    return df.orderBy(*(order or df.columns[:1])).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()
