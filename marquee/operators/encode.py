"""Categorical encoders: one-hot (wide and sparse), ordinal, target encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import normalize_category
from marquee.operators.profile import _q
from marquee.session import cut_lineage


#: dummy columns that one categorical column makes at most
MAX_LEVELS = 10_000


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values, each of which becomes a column; more than ``max_levels`` are an error."""
    rows = df.where(_q(col).isNotNull()).select(_q(col).alias("v")).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels; use one_hot_sparse")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, cols: list[str], normalise: bool = True, drop_first: bool = False,
            as_bool: bool = False, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Dummy columns ``{col}_{level}`` for each level (sorted); originals dropped.

    ``normalise`` (UI path): strip/upper, "NAN"/null -> "UNKNOWN" first, int dummies.
    Service path: ``drop_first=True, as_bool=True`` on raw values; null -> all zero.
    Other columns keep their order and come first.  A level's text is kept as it is.
    A column of more than ``max_levels`` levels is an error; ``one_hot_sparse`` takes any number.
    """
    work = df.withColumns({c: normalize_category(c) for c in cols}) if normalise else df
    dummies = []
    for c in cols:
        lv = levels(work, c, max_levels)
        if drop_first:
            lv = lv[1:]
        for v in lv:
            d = F.coalesce(_q(c) == F.lit(v), F.lit(False))
            dummies.append((d if as_bool else d.cast("int")).alias(f"{c}_{v}"))
    keep = [_q(c) for c in work.columns if c not in cols]
    return work.select(*keep, *dummies)


def one_hot_sparse(df: DataFrame, cols: list[str], normalise: bool = True) -> DataFrame:
    """Scale variant: ``StringIndexer`` + ``OneHotEncoder`` into sparse vectors
    ``{col}_ohe``, as long as there are levels (ordered alphabetically); null is all zero."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    work = df.withColumns({c: normalize_category(c) for c in cols}) if normalise else df
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep") for c in cols]
    # the indexer numbers null last, so dropping the last category drops that one only
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols],
                                dropLast=True, handleInvalid="error"))
    out = Pipeline(stages=stages).fit(work).transform(work)
    return out.drop(*[f"{c}__idx" for c in cols], *cols)


def ordinal(df: DataFrame, mapping: dict[str, list]) -> DataFrame:
    """Replace each column by the position of its value in the given order; unknown/null -> -1."""
    return df.withColumns({
        c: (F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), _q(c)), F.lit(0)) - 1).cast("int")
        for c, order in mapping.items()})


@dataclass
class TargetEncoding:
    """Fitted level -> mean(target) tables (fit on training rows only to avoid leakage)."""
    cols: list[str]
    tables: dict
    normalise: bool

    def transform(self, df: DataFrame, keep_original: bool = True) -> DataFrame:
        out = df.withColumns({c: normalize_category(c) for c in self.cols}) if self.normalise else df
        for c in self.cols:
            t = self.tables[c]
            out = out.join(t, out[c].eqNullSafe(t["_lvl"]), "left").drop("_lvl")
        if not keep_original:
            out = out.drop(*self.cols)
        return out

    def mapping_table(self) -> DataFrame:
        parts = [t.select(F.lit(c).alias("column"), F.col("_lvl").cast("string").alias("level"),
                          F.col(f"{c}__target").alias("target_mean")) for c, t in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def target_encode_fit(df: DataFrame, cols: list[str], target: str = "price", normalise: bool = True) -> TargetEncoding:
    """Mean of ``target`` per level (null level excluded, as pandas groupby does).

    Level tables are checkpointed once; AQE chooses the joins by their size.
    """
    work = df.withColumns({c: normalize_category(c) for c in cols}) if normalise else df
    tables = {}
    for c in cols:
        t = (work.where(_q(c).isNotNull()).groupBy(_q(c).alias("_lvl"))
             .agg(F.avg(F.col(target).cast("double")).alias(f"{c}__target")))
        tables[c] = cut_lineage(t)
    return TargetEncoding(cols, tables, normalise)


def target_encode(df: DataFrame, cols: list[str], target: str = "price", normalise: bool = True,
                  keep_original: bool = True) -> DataFrame:
    """Fit on ``df`` and transform it (the UI behaviour; prefer fit on train rows)."""
    return target_encode_fit(df, cols, target, normalise).transform(df, keep_original)
