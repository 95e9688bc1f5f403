"""Schema-level helpers: renames, guards, ordering, type families, coercions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: identifier synonyms and catalogue aliases
TITLE_ID_SYNONYMS = ["tconst", "imdb_id"]
CATALOG_ALIASES = {"primary_title": "primaryTitle", "startYear": "releaseYear",
                   "tconst": "title_id", "titleId": "title_id"}
CORE_OPTIONAL = {"numVotes": "bigint", "averageRating": "double", "runtimeMinutes": "int",
                 "titleType": "string", "genres": "string"}
# fixed values: preferred head of the feature master, then pv_* sorted, then has_entity
PREFERRED_HEAD = ["license_id", "title", "title_final", "title_norm", "release_year",
                  "tconst", "method", "match_score",
                  "titleType", "startYear", "genres", "runtimeMinutes",
                  "averageRating", "numVotes", "log1p_numVotes"]
PREFERRED_TAIL = ["has_entity"]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename id synonyms to ``title_id``; two competing id columns are an error."""
    present = [c for c in TITLE_ID_SYNONYMS if c in df.columns]
    if len(present) + ("title_id" in df.columns) > 1:
        raise ValueError(f"ambiguous title id columns: {present + ['title_id']}")
    return df.withColumnsRenamed({c: "title_id" for c in present}) if present else df


def rename_alias(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Catalogue aliases; a rename whose target already exists is skipped."""
    mapping = {s: t for s, t in (aliases or CATALOG_ALIASES).items()
               if s in df.columns and t not in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


def ensure_columns(df: DataFrame, spec: dict[str, str] | None = None) -> DataFrame:
    """Add missing optional columns as typed nulls."""
    add = {c: F.lit(None).cast(t) for c, t in (spec or CORE_OPTIONAL).items() if c not in df.columns}
    return df.withColumns(add) if add else df


def require_columns(df: DataFrame, required: Iterable[str], name: str = "frame") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} missing required columns: {missing}")
    return df


def preferred_column_order(df: DataFrame) -> DataFrame:
    """Stable sort of the columns by (group, place): head list, pv_ columns by name, tail list, the rest."""
    def place(c: str) -> tuple:
        if c in PREFERRED_HEAD:
            return (0, PREFERRED_HEAD.index(c), "")
        if c.startswith("pv_"):
            return (1, 0, c)
        return (2, PREFERRED_TAIL.index(c), "") if c in PREFERRED_TAIL else (3, 0, "")
    return df.select(*sorted(df.columns, key=place))


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def select_dtypes(df: DataFrame, family: str) -> list[str]:
    """``numeric`` (bool excluded), ``datetime``, or ``categorical`` (everything else)."""
    out = []
    for f in df.schema.fields:
        is_num = isinstance(f.dataType, _NUMERIC)
        is_time = isinstance(f.dataType, _TIME)
        if (family == "numeric" and is_num) or (family == "datetime" and is_time) or \
                (family == "categorical" and not is_num):
            out.append(f.name)
    return out


def dtypes_table(df: DataFrame) -> DataFrame:
    """Schema as rows (column, dtype, family, position) - no job over the data."""
    fam = {c: "numeric" for c in select_dtypes(df, "numeric")}
    fam.update({c: "datetime" for c in select_dtypes(df, "datetime")})
    rows = [(f.name, f.dataType.simpleString(), fam.get(f.name, "categorical"), i)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, family string, position int")


def epoch_micros(df: DataFrame, c: str) -> Column:
    """Microseconds since 1970: of a zone-less time by its own calendar and clock, whatever the session's zone."""
    x, kind = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x)
    day = F.unix_date(F.to_date(x)).cast("long") * 86_400_000_000
    if isinstance(kind, T.DateType):
        return day
    if isinstance(kind, T.TimestampNTZType):
        second = (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")
        return day + F.hour(x).cast("long") * 3_600_000_000 + F.minute(x).cast("long") * 60_000_000 + second
    return F.unix_micros(x.cast("timestamp"))       # text: read in the session's zone


def release_year_cast(c, mode: str = "parity") -> Column:
    """Catalogue start year -> bigint.

    ``parity``: null -> 0, unparsable text fails the job (ANSI cast).
    ``lenient``: unparsable -> null, null stays null.
    """
    col = F.col(c) if isinstance(c, str) else c
    if mode == "parity":
        return F.coalesce(col, F.lit(0)).cast("string").cast("double").cast("bigint")
    return col.cast("string").try_cast("double").try_cast("bigint")


def to_datetime_coerce(c) -> Column:
    """Invalid values -> null (pandas ``errors='coerce'``)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string").try_cast("timestamp_ntz"),
                      F.try_to_timestamp(col.cast("string")).cast("timestamp_ntz"))
