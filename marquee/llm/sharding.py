"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the rank as a share
of the source's rows, (rank + 1/2) / rows, is a place between 0 and 1. Sorted by that
place, every stretch holds the sources in the proportions of the whole, so cutting the
order into equal counts gives shards that each match the mixture and differ by at most
one row.

Ranks are taken over buckets whose counts are summed first (``common.ranked``): a source
or a stretch of any size is spread over many tasks, and nothing is collected.

Defined cases: a null source is a stratum of its own; an empty or null text has size 1
and CRC 0; rows that repeat with all the same values are interchangeable (they get
different slots, and which of them gets which cannot be told); a very long text is one row
like any other; an empty table gives an empty result. Extra columns are kept as they are by ``shard``, unless they bear the name
of an output column: the output column replaces such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, ranked, read_table, seeded_hex

SEED = "marquee-shard-1"
ROWS_PER_BUCKET = 20_000


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text", seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """All rows with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    ``keep`` names the columns to carry (default: all). Only ids, sources and hashes go
    through the sorts; carried columns ride along, so name few of them where you can.
    """
    n = docs.count()
    buckets = max(2 * partitions(docs.sparkSession), -(-n // ROWS_PER_BUCKET))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"),
        F.col(source_col).alias("_src"),
        seeded_hex(seed, F.col(id_col)).alias("_h"),
        F.col(id_col).cast("string").alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_x"))
    by_hash = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32))
    rows = ranked(rows, ["_src"], by_hash, [F.col("_h"), F.col("_id"), F.col("_x")], "_rank")
    counts = rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col("_src").alias("_csrc"), "_n")
    rows = rows.join(counts, F.col("_src").eqNullSafe(F.col("_csrc"))).drop("_csrc")
    place = (F.col("_rank").cast("double") + F.lit(0.5)) / F.col("_n").cast("double")
    rows = rows.withColumn("_place", place)
    order = [F.col("_place"), F.col("_src").asc_nulls_last(), F.col("_rank")]
    rows = ranked(rows, [], F.floor(F.col("_place") * F.lit(float(buckets))), order, "_pos")
    at = F.expr(f"(_pos * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return (rows.withColumn("shard", at.cast("int"))
            .withColumn("slot", (F.col("_pos") - first).cast("long"))
            .select("_row.*", "shard", "slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 under the ``rows`` law (counts at most one apart)."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    out = shard(docs, 8, keep=["doc_id", "source", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")
