"""Readers and writers.  Paths are plain Hadoop paths (local, hdfs://, s3a://)."""

from __future__ import annotations

import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _with_suffix(path: str, suffix: str) -> str:
    return path if path.lower().endswith(suffix) else path + suffix


def read_parquet(spark: SparkSession, path: str, base_dir: str | None = None) -> DataFrame:
    p = _with_suffix(path, ".parquet")
    if base_dir:
        p = posixpath.join(base_dir, p)
    return spark.read.parquet(p)


def read_csv(spark: SparkSession, path: str, schema=None, multiline: bool = False) -> DataFrame:
    """Header CSV with RFC 4180 quotes (a quote inside a field is doubled).

    ``multiline`` is for files whose quoted fields hold line breaks; such files are read
    whole by one task each. An explicit schema avoids the inference pass (prefer it at scale)."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """TSV or TSV.GZ with ``\\N`` as null (gzip is read whole by one task per file)."""
    r = spark.read.option("header", True).option("sep", "\t").option("nullValue", "\\N").option("quote", "")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, multiline: bool = False, schema=None) -> DataFrame:
    """JSON lines (splittable); ``multiline`` for files that hold one document or array each."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch on the lower-cased suffix: .parquet, .json, .tsv / .tsv.gz, else CSV."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".json"):
        return read_json(spark, path, **kw)
    if low.endswith(".tsv") or low.endswith(".tsv.gz"):
        return read_tsv(spark, path, **kw)
    if low.endswith(".csv") or low.endswith(".csv.gz") or low.endswith(".txt"):
        return read_csv(spark, path, **kw)
    raise ValueError(f"unsupported source type: {path}")


def scan_head(df: DataFrame, n: int = 50_000, columns: list[str] | None = None,
              order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows of an optional column projection, in ``order`` or else in source order.

    Source order is by file path and place in the file, so ``df`` must be a scan of files
    (filters and projections of stored columns allowed). For Parquet the files' row counts
    come from a scan without columns; only the files that hold the first n rows are read, by
    row index, and nothing is sorted. For other formats places are block starts and row
    numbers, and each task hands on its own first n rows.
    """
    out = df.select(*columns) if columns else df
    if order:
        return out.orderBy(*order).limit(n)
    names = out.columns
    try:
        placed = df.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return _head_by_blocks(df, names, n)
    # as files, not as rows, are numbered, the window runs over one row a file
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < n)
    take = {r["_file"]: min(r["_rows"], n - r["_before"]) for r in first.collect()}     # at most n files, none empty
    if not take:
        return out.limit(0)
    kept = placed.where(F.col("_metadata.file_path").isin(list(take)))
    part = {f: k for f, k in take.items()}
    last = max(part)
    # all files but the last are wanted whole
    return kept.where((F.col("_file") != last) | (F.col("_row") < part[last])).select(*names)


def _head_by_blocks(df: DataFrame, names: list[str], n: int) -> DataFrame:
    try:
        placed = df.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                           F.monotonically_increasing_id().alias("_at"))
    except AnalysisException:
        raise ValueError("rows that come from no file have no source order: give an order") from None
    return placed.orderBy("_file", "_block", "_at").limit(n).select(*names)


def base_name(src: str) -> str:
    """Source file name without query string and data suffixes (.tsv, .gz, .csv, ...)."""
    name = posixpath.basename(src.split("?", 1)[0].rstrip("/"))
    return re.sub(r"(\.(tsv|csv|json|parquet|gz|txt))+$", "", name, flags=re.IGNORECASE)


def ingest_raw(spark: SparkSession, src: str, root: str, run_id: str, cap_n_rows: int | None = None,
               name: str | None = None, **reader) -> str:
    """Any source -> ``<root>/<run_id>/<name>.parquet``; returns the path.

    ``cap_n_rows`` keeps the source's first rows (None = whole source); ``reader`` goes to the
    source's reader (``schema``, ``multiline``)."""
    df = read_any(spark, src, **reader)
    if cap_n_rows is not None:
        df = scan_head(df, cap_n_rows)
    out = posixpath.join(root, run_id, f"{name or base_name(src)}.parquet")
    df.write.mode("overwrite").parquet(out)
    return out


def write_parquet(df: DataFrame, root: str, run_id: str, name: str, partition_by: list[str] | None = None) -> str:
    out = posixpath.join(root, run_id, _with_suffix(name, ".parquet"))
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)
    return out


def write_csv(df: DataFrame, root: str, run_id: str, name: str) -> str:
    out = posixpath.join(root, run_id, _with_suffix(name, ".csv"))
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(out)
    return out


def write_json(df: DataFrame, root: str, run_id: str, name: str, stamp: str | None = None) -> str:
    """JSON lines under ``<name>_<stamp>.json`` (stamp: YYYYmmdd_HHMM when given)."""
    fname = f"{name}_{stamp}.json" if stamp else _with_suffix(name, ".json")
    out = posixpath.join(root, run_id, fname)
    df.write.mode("overwrite").json(out)
    return out
