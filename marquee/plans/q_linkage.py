"""Queries: catalogue, candidate universe, id map, metadata resolution, feature master."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.text import normalize_title
from marquee.operators import linkage as L
from marquee.plans import sqltext as S
from marquee.plans.features import build_catalogue, feature_build, feature_master, prepare_base, reference_price
from marquee.plans.registry import query, rnd, tables


def _cat(t, store=False):
    return build_catalogue(t["title_basics"], t["title_ratings"], t["title_akas"], store=store)


@query("catalog_core", f"with {S.CORE.strip()} select title_id, titleType, primaryTitle, runtimeMinutes, "
       "genres, round(averageRating, 6) as averageRating, numVotes, releaseYear, primary_title_norm from core")
def q_catalog_core(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rnd(_cat(t).core)


@query("catalog_akas", f"with {S.AKAS.strip()} select * from akas")
def q_catalog_akas(spark, sf_dir):
    return _cat(tables(spark, sf_dir)).akas


@query("candidate_universe", f"with {S.CORE.strip()},{S.AKAS},{S.CAND} select * from cand")
def q_candidate_universe(spark, sf_dir):
    return _cat(tables(spark, sf_dir)).cand


@query("id_entity_map", f"with {S.linkage_ctes('intended', 'idmap')} select * from idmap")
def q_id_entity_map(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.id_entity_map(prepare_base(t["licensing"]), _cat(t).core, "intended")


@query("id_entity_map_parity", f"with {S.linkage_ctes('parity', 'idmap')} select * from idmap")
def q_id_entity_map_parity(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.id_entity_map(prepare_base(t["licensing"]), None, "parity")


@query("unmatched", f"with {S.linkage_ctes('intended', 'unm')} "
       "select license_id, title_id, release_year, territory, round(price, 6) as price from unm")
def q_unmatched(spark, sf_dir):
    t = tables(spark, sf_dir)
    base = prepare_base(t.stored("licensing", _BASE_COLS))
    cat = _cat(t, store=True)
    u = L.unmatched(base, L.id_entity_map(base, cat.core, "intended"))
    return rnd(u.select("license_id", "title_id", "release_year", "territory", "price"))


@query("resolve_entities", f"with {S.linkage_ctes('intended', 'er')} "
       "select license_id, title_id, method, round(match_score, 6) as match_score from er")
def q_resolve_entities(spark, sf_dir):
    t = tables(spark, sf_dir)
    base = L.linkage_columns(prepare_base(t["licensing"]))
    cat = _cat(t, store=True)
    rest = L.unmatched(base, L.id_entity_map(base, cat.core, "intended"))
    return rnd(L.resolve_entities(rest, cat.cand, snapshot=False))


@query("resolve_entities_parity", f"with {S.linkage_ctes('parity', 'er')} "
       "select license_id, title_id, method, round(match_score, 6) as match_score from er")
def q_resolve_entities_parity(spark, sf_dir):
    t = tables(spark, sf_dir)
    base = L.linkage_columns(prepare_base(t["licensing"]))
    cat = _cat(t, store=True)
    rest = L.unmatched(base, L.id_entity_map(base, None, "parity"))
    return rnd(L.resolve_entities(rest, cat.cand, snapshot=False))


@query("entity_mapping", f"with {S.linkage_ctes('intended', 'ranked')} "
       "select license_id, title_id, method, round(match_score, 6) as match_score from emap")
def q_entity_mapping(spark, sf_dir):
    t = tables(spark, sf_dir)
    cat = _cat(t, store=True)
    m = L.entity_mapping(prepare_base(t["licensing"]), cat.core, cat.cand)
    return rnd(m.select(*L.MAPPING_COLUMNS))


@query("mapping_stats", f"with {S.linkage_ctes('intended', 'ranked')} "
       "select count(*) as total, count(*) filter (where method = 'id_exact') as id_matches, "
       "count(*) filter (where method <> 'id_exact') as metadata_rows, "
       "round(100.0 * avg(case when title_id is not null then 1.0 else 0.0 end), 6) as hit_pct from emap")
def q_mapping_stats(spark, sf_dir):
    t = tables(spark, sf_dir)
    cat = _cat(t, store=True)
    return L.mapping_stats(L.entity_mapping(prepare_base(t["licensing"]), cat.core, cat.cand))


@query("rank_entity_map", f"with {S.linkage_ctes('intended', 'ranked')} "
       "select license_id, title_id, method, round(match_score, 6) as match_score from ranked")
def q_rank_entity_map(spark, sf_dir):
    t = tables(spark, sf_dir)
    cat = _cat(t, store=True)
    m = L.entity_mapping(prepare_base(t["licensing"]), cat.core, cat.cand)
    return rnd(L.rank_entity_map(m.select(*L.MAPPING_COLUMNS)))


_BASE_COLS = ["license_id", "title_id", "title", "release_year", "territory", "price"]
_FM_COLS = ["license_id", "title_id", "method", "match_score", "title_final", "releaseYear",
            "numVotes", "averageRating", "log1p_numVotes", "has_entity", "price"]


def _fm_sql(mode):
    cols = ", ".join(f"round({c}, 6) as {c}" if c in ("match_score", "averageRating", "log1p_numVotes", "price")
                     else c for c in _FM_COLS)
    return f"with {S.linkage_ctes(mode)},{S.feature_master_sql(mode)} select {cols} from feature_master"


@query("feature_master", _fm_sql("intended"))
def q_feature_master(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rnd(feature_master(t.stored("licensing", _BASE_COLS), _cat(t, store=True), mode="intended", stored=True).select(*_FM_COLS))


@query("feature_build", _fm_sql("intended"))
def q_feature_build(spark, sf_dir):
    """The staged tables under names of their own; roles come from the names and the columns."""
    t = tables(spark, sf_dir)
    staged = {"titles.tsv": t["title_basics"], "deals": t.stored("licensing", _BASE_COLS), "akas_2024": t["title_akas"], "scores": t["title_ratings"]}
    return rnd(feature_build(staged, stored=True).select(*_FM_COLS))


@query("feature_master_parity", _fm_sql("parity"))
def q_feature_master_parity(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rnd(feature_master(t.stored("licensing", _BASE_COLS), _cat(t, store=True), mode="parity", stored=True).select(*_FM_COLS))


_TERR_SQL = (f"with {S.linkage_ctes('intended')},{S.feature_master_sql('intended')} "
             "select territory, count(*) as licences, round(avg(price), 6) as avg_price, "
             "round(100.0 * avg(has_entity), 6) as hit_pct, "
             "count(*) filter (where method = 'meta_year+region+votes') as metadata_matches "
             "from feature_master group by territory")


def territory_summary(fm):
    return rnd(fm.groupBy("territory").agg(
        F.count(F.lit(1)).alias("licences"), F.avg("price").alias("avg_price"),
        (100.0 * F.avg("has_entity")).alias("hit_pct"),
        F.count_if(F.col("method") == L.META_METHOD).alias("metadata_matches")))


@query("territory_summary", _TERR_SQL)
def q_territory_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    return territory_summary(feature_master(t.stored("licensing", _BASE_COLS), _cat(t, store=True), mode="intended", stored=True))


# titles of licences as they were sold (brand after "__"), one row for each title and year
_SOLD = "trim(split_part({}, '__', 1))".format


@query("title_similarity_join",
       f"with {S.CORE.strip()}, sold as (select {S.norm_title(_SOLD('title'))} as title_norm, cast(release_year as bigint) as release_year, "
       "min(license_id) as license_id from licensing group by 1, 2), "
       "pairs as (select s.license_id, c.title_id, 1.0 - cast(levenshtein(s.title_norm, c.primary_title_norm) as double) "
       "/ greatest(length(s.title_norm), length(c.primary_title_norm)) as similarity "
       "from sold s join core c on abs(c.releaseYear - s.release_year) <= 1) "
       "select distinct license_id, title_id, round(similarity, 6) as similarity from pairs where similarity >= 0.7")
def q_title_similarity_join(spark, sf_dir):
    t = tables(spark, sf_dir)
    sold = t["licensing"].select("license_id", "release_year", normalize_title(F.trim(F.split_part("title", F.lit("__"), F.lit(1)))).alias("title_norm"))
    sold = sold.groupBy("title_norm", "release_year").agg(F.min("license_id").alias("license_id"))
    core = _cat(t).core.select("title_id", F.col("primary_title_norm").alias("title_norm"), "releaseYear")
    return L.title_similarity_join(sold, core, 0.7, year_slack=1)
