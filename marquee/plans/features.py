"""Feature master: licences linked to the catalogue, one lazy plan to one write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import normalize_columns, preferred_column_order, require_columns
from marquee.functions.text import normalize_title
from marquee.operators import linkage as L
from marquee.operators.profile import group_quantiles
from marquee.session import save_table
from marquee.sources.artifacts import auto_roles


@dataclass
class Catalogue:
    core: DataFrame
    akas: DataFrame
    cand: DataFrame


def build_catalogue(basics: DataFrame, ratings: DataFrame, akas_raw: DataFrame,
                    year_mode: str = "parity", store: bool = False) -> Catalogue:
    """``store`` writes the core once; linkage reads it four times."""
    core = L.catalog_core(basics, ratings, year_mode)
    core = save_table(core, "catalogue") if store else core
    require_columns(core, ["title_id", "primaryTitle", "releaseYear", "primary_title_norm"], "catalogue core")
    akas = L.catalog_akas(akas_raw)
    cand = L.candidate_universe(core, akas)
    return Catalogue(core, akas, cand)


def prepare_base(base: DataFrame) -> DataFrame:
    require_columns(base, ["license_id", "title", "release_year"], "base")
    return base.withColumn("title_norm", normalize_title("title"))


def _linked(base: DataFrame, cat: Catalogue, cfg: L.LinkageConfig, mode: str, mapping: DataFrame | None, stored: bool,
            rollup: DataFrame | None = None) -> DataFrame:
    """base LEFT JOIN the best mapping of its licence, with the title id that reaches the catalogue."""
    base = prepare_base(base) if "title_norm" not in base.columns else base
    emap = mapping if mapping is not None else L.entity_mapping(base, cat.core, cat.cand, cfg, mode, stored, rollup)
    ranked = L.rank_entity_map(emap.select(*L.MAPPING_COLUMNS), cfg, mode)
    if mode == "parity":
        return base.join(ranked.select("license_id", "method", "match_score"), "license_id", "left")
    m = ranked.select("license_id", "method", "match_score", F.col("title_id").alias("_mapped_id"))
    return (base.join(m, "license_id", "left")
            .withColumn("title_id", F.coalesce(F.col("_mapped_id"), F.col("title_id")))
            .drop("_mapped_id"))


def _linked_singly(base: DataFrame, titles: DataFrame, cat: Catalogue, cfg: L.LinkageConfig, mode: str, rollup: DataFrame) -> DataFrame:
    """``_linked`` and joined with ``titles``, for rows that are the only ones of their licence.

    A row's one mapping is its best, and carries the row and the title's columns. In ``parity`` mode a mapped title id
    does not reach the catalogue, so only the row's own brings columns.
    """
    rest = [c for c in base.columns if c not in ("license_id", "title_id")]
    found = [c for c in titles.columns if c != "title_id"]
    emap = L.entity_mapping(base.withColumn("_base_id", F.col("title_id")), cat.core, cat.cand, cfg, mode, True, rollup, ["_base_id", *rest], titles)
    own = F.col("_base_id")
    if mode == "parity":
        emap = emap.withColumns({"title_id": own, **{c: F.when(own.isNotNull(), F.col(c)) for c in found}})
    out = emap.withColumn("title_id", F.coalesce("title_id", own)).select(*base.columns, "method", "match_score", *found)
    out = prepare_base(out) if "title_norm" not in base.columns else out
    last = ["method", "match_score", *found]
    return out.select("title_id", "license_id", *[c for c in out.columns if c not in ("license_id", "title_id", *last)], *last)


def feature_master(base: DataFrame, cat: Catalogue, cfg: L.LinkageConfig = L.LinkageConfig(),
                   mode: str = "intended", mapping: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """base LEFT JOIN best mapping (method, score) LEFT JOIN catalogue attributes + features.

    ``parity``: the mapping's title id is dropped, so only the base id reaches the
    catalogue (as in the reference).  ``intended``: the mapped id wins when present.
    Joins are left joins on equality keys; AQE picks broadcast vs sort-merge from
    runtime sizes and splits skewed licence partitions. ``stored``: the base is a written table,
    so linkage reads it as it is, and rows that are the only ones of their licence are mapped where they stand
    and move by title once, for the id map and the catalogue's columns together.
    """
    titles = cat.core.select("title_id", "primaryTitle", "primary_title_norm", "releaseYear",
                             "titleType", "averageRating", "numVotes").dropDuplicates(["title_id"]).withColumn("_known", F.lit(True))
    if mapping is None and stored:
        titles = save_table(titles, "titles")     # read by the id map, for the rows it leaves and for the winners
        rollup = L.candidate_rollup(cat.cand)
        single, several = L.split_by_licence(base)
        parts = [_linked(several, cat, cfg, mode, None, stored, rollup).join(titles, "title_id", "left")] if several is not None else []
        parts += [_linked_singly(single, titles, cat, cfg, mode, rollup)] if single is not None else []
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    else:
        out = _linked(base, cat, cfg, mode, mapping, stored).join(titles, "title_id", "left")
    out = out.withColumns({
        "title_final": F.coalesce(F.col("primaryTitle"), F.col("title")),
        "log1p_numVotes": F.log1p(F.coalesce(F.col("numVotes").cast("double"), F.lit(0.0))),
        # a title that the catalogue does not hold is no entity (parity counts any id)
        "has_entity": F.col("title_id" if mode == "parity" else "_known").isNotNull().cast("int"),
    }).drop("_known")
    return preferred_column_order(out)


def roles_of(staged: dict[str, DataFrame], mode: str = "intended") -> dict[str, str | None]:
    """The staged table for each role, by names and column signatures."""
    return auto_roles({label: df.columns for label, df in staged.items()}, mode)


def feature_build(staged: dict[str, DataFrame], roles: dict[str, str] | None = None, cfg: L.LinkageConfig = L.LinkageConfig(),
                  mode: str = "intended", stored: bool = False) -> DataFrame:
    """Staged tables -> feature master in one call: guess roles, normalise columns, assemble the catalogue, link.

    ``roles`` overrides the guess for the roles it names. A table may not fill two roles.
    ``stored``: the base table is a written one, not a view that is computed at each reading.
    """
    chosen = {**roles_of(staged), **(roles or {})}
    missing = [r for r, label in chosen.items() if label not in staged]
    if missing:
        raise ValueError(f"no staged table for {', '.join(missing)}")
    if len(set(chosen.values())) < len(chosen):
        raise ValueError(f"a table fills two roles: {chosen}")
    base = normalize_columns(staged[chosen["base"]])
    cat = build_catalogue(staged[chosen["basics"]], staged[chosen["ratings"]], staged[chosen["akas"]], store=True)
    return feature_master(base, cat, cfg, mode, stored=stored)


# fixed values: seasonality multiplier by start month (1..12)
SEASONALITY = [0.8, 0.85, 1.0, 1.0, 1.05, 1.1, 1.15, 1.15, 1.1, 1.05, 1.0, 0.85]
HALF_LIFE_DAYS = 180
MAX_UPLIFT = 0.25


def reference_price(df: DataFrame, territory_base: DataFrame | None = None, places: int = 2) -> DataFrame:
    """Re-aimed licensing price curve, deterministic per row.

    price = max(0, base * season[month(window_start)] * (1 + 0.25 * 2^(-days/180)))
            * (1 - 0.12 * min(1, log1p(units)/10)), rounded to 2 places,
    with days = max(0, window_start - Jan 1 of release_year) (the deal date stands
    in for "today") and base = the per-territory median price (or a given table
    ``territory, base_price``, broadcast: one row per territory). Medians are exact and come
    from a histogram in ranges, so no task holds a territory's prices.
    """
    if territory_base is None:
        prices = df.select("territory", F.col("price").cast("double").alias("price")).dropna()
        medians = group_quantiles(prices, "territory", "price", [0.5])
        territory_base = df.sparkSession.createDataFrame([(t, q[0]) for t, q in sorted(medians.items())], "territory string, base_price double")
    ry = F.coalesce(F.col("release_year").cast("int"), F.year("window_start"))
    # age since release, floored at 0: a deal dated before the release gets the full uplift
    days = F.greatest(F.lit(0.0), F.datediff(F.to_date("window_start"),
                                             F.make_date(ry, F.lit(1), F.lit(1))).cast("double"))
    season = F.element_at(F.array(*[F.lit(x) for x in SEASONALITY]), F.month("window_start"))
    fresh = 1.0 + MAX_UPLIFT * F.exp(-F.log(F.lit(2.0)) * days / F.greatest(F.lit(1.0), F.lit(float(HALF_LIFE_DAYS))))
    vol = 1.0 - 0.12 * F.least(F.lit(1.0), F.log1p(F.coalesce(F.col("units"), F.lit(0.0))) / 10.0)
    price = F.greatest(F.lit(0.0), F.col("base_price") * season * fresh) * vol
    return (df.join(F.broadcast(territory_base), "territory", "left")
            .withColumn("reference_price", F.round(price, places)))
