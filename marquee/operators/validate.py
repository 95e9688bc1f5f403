"""Partial, coercing, non-strict schema validation with a long failure table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import TITLE_ID_SYNONYMS
from marquee.operators.profile import _q

# fixed values: canonical licence schema (all optional, all nullable, extras allowed)
CANONICAL = {"title_id": "string", "title": "string", "territory": "string", "media": "string",
             "platform": "string", "release_year": "bigint", "window_start": "timestamp_ntz",
             "window_end": "timestamp_ntz", "price": "double"}
_PANDAS_NAME = {"string": "str", "bigint": "int64", "timestamp_ntz": "datetime64[ns]", "double": "float64"}


@dataclass
class Validation:
    status: str                 # "passed" | "failed"
    frame: DataFrame            # coerced frame if passed, else the original
    failures: DataFrame         # (column, check, failure_case)


def _coerce(c: str, t: str):
    src = _q(c)
    if t == "bigint":
        return src.cast("string").try_cast("double").try_cast("bigint")
    if t == "timestamp_ntz":
        return src.cast("string").try_cast("timestamp_ntz")
    if t == "double":
        return src.cast("string").try_cast("double")
    return src.cast(t)


def failure_table(df: DataFrame) -> DataFrame:
    """All failures of the present canonical columns: coercion failures
    (value present, cast null) and ``price > 0`` (null passes)."""
    work = df
    for s in TITLE_ID_SYNONYMS:
        if s in work.columns and "title_id" not in work.columns:
            work = work.withColumnRenamed(s, "title_id")
    present = [c for c in CANONICAL if c in work.columns]
    items = []
    for c in present:
        t = CANONICAL[c]
        if t != "string":
            bad = _q(c).isNotNull() & _coerce(c, t).isNull()
            items.append(F.when(bad, F.struct(F.lit(c).alias("column"),
                                              F.lit(f"coerce_dtype('{_PANDAS_NAME[t]}')").alias("check"),
                                              _q(c).cast("string").alias("failure_case"))))
    if "price" in present:
        p = _coerce("price", "double")
        items.append(F.when(p.isNotNull() & (p <= 0), F.struct(
            F.lit("price").alias("column"), F.lit("greater_than(0)").alias("check"),
            _q("price").cast("string").alias("failure_case"))))
    schema = "column string, check string, failure_case string"
    if not items:
        return df.sparkSession.createDataFrame([], schema)
    return (work.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("f"))
            .select("f.*"))


def schema_validate(df: DataFrame) -> Validation:
    fails = failure_table(df)
    # one small job: do any failures exist
    failed = fails.limit(1).count() > 0
    if failed:
        return Validation("failed", df, fails)
    work = df
    for s in TITLE_ID_SYNONYMS:
        if s in work.columns and "title_id" not in work.columns:
            work = work.withColumnRenamed(s, "title_id")
    work = work.withColumns({c: _coerce(c, t) for c, t in CANONICAL.items() if c in work.columns})
    return Validation("passed", work, fails)


def schema_report(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, cols) after a successful validation."""
    n = df.count()
    rows = [(f.name, f.dataType.simpleString(), n, len(df.columns)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, rows long, cols int")
