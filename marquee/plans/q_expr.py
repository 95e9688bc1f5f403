"""Queries: scalar expressions, schema helpers, ranking, set operations, report datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import columns as COL
from marquee.functions.text import normalize_category, normalize_title
from marquee.operators import linkage as L
from marquee.operators import rank as RK
from marquee.plans import reports as R
from marquee.plans import sqltext as S
from marquee.plans.features import build_catalogue, prepare_base, reference_price
from marquee.plans.registry import query, rnd, tables

# Java's Unicode \s set, written out for DuckDB's RE2 (whose \s is ASCII-only)
_UWS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PYWS = ("chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || "
         "chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || "
         "chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || "
         "chr(8239) || chr(8287) || chr(12288)")


def _norm_sql(x):
    s = f"trim(lower(coalesce({x}, '')), {_PYWS})"
    s = f"replace({s}, '_', ' ')"
    s = f"regexp_replace({s}, '{_UWS}+', ' ', 'g')"
    return f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\t\\n\\x0b\\x0c\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')"


@query("normalize_title", f"select doc_id, {_norm_sql('text')} as title_norm from documents")
def q_normalize_title(spark, sf_dir):
    """Title normalisation over whole document texts (Unicode, four languages)."""
    d = tables(spark, sf_dir)["documents"]
    return d.select("doc_id", normalize_title("text").alias("title_norm"))


@query("normalize_title_licensing", f"select license_id, {S.norm_title('title')} as title_norm from licensing")
def q_normalize_title_licensing(spark, sf_dir):
    return prepare_base(tables(spark, sf_dir)["licensing"]).select("license_id", "title_norm")


_MESSY = ("case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then ' nan ' "
          "else concat(' ', lower(c_mktsegment), ' ') end")


@query("normalize_category", f"select c_custkey, case when upper(trim(({_MESSY}), {_PYWS})) is null or "
       f"upper(trim(({_MESSY}), {_PYWS})) = 'NAN' then 'UNKNOWN' else upper(trim(({_MESSY}), {_PYWS})) end as segment "
       "from customer")
def q_normalize_category(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"]
    messy = (F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit(" nan "))
             .otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "))))
    return c.select("c_custkey", normalize_category(messy).alias("segment"))


_TF_SQL = (f"with {S.CORE.strip()}, j as (select l.license_id, l.title, l.title_id, c.primaryTitle, c.numVotes "
           "from licensing l left join core c on l.title_id = c.title_id) ")


def _title_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    cat = build_catalogue(t["title_basics"], t["title_ratings"], t["title_akas"])
    j = t["licensing"].select("license_id", "title", "title_id").join(
        cat.core.select("title_id", "primaryTitle", "numVotes"), "title_id", "left")
    return j.select("license_id",
                    F.coalesce("primaryTitle", "title").alias("title_final"),
                    F.log1p(F.coalesce(F.col("numVotes").cast("double"), F.lit(0.0))).alias("log1p_numVotes"),
                    F.col("title_id").isNotNull().cast("int").alias("has_entity"))


@query("title_final", _TF_SQL + "select license_id, coalesce(primaryTitle, title) as title_final from j")
def q_title_final(spark, sf_dir):
    return _title_features(spark, sf_dir).select("license_id", "title_final")


@query("log1p_votes", _TF_SQL + "select license_id, round(ln(1 + cast(coalesce(numVotes, 0) as double)), 6) "
       "as log1p_numVotes from j")
def q_log1p_votes(spark, sf_dir):
    return rnd(_title_features(spark, sf_dir).select("license_id", "log1p_numVotes"))


@query("has_entity", _TF_SQL + "select license_id, case when title_id is not null then 1 else 0 end as has_entity from j")
def q_has_entity(spark, sf_dir):
    return _title_features(spark, sf_dir).select("license_id", "has_entity")


@query("release_year_cast", "select tconst, cast(coalesce(startYear, 0) as bigint) as releaseYear from title_basics")
def q_release_year_cast(spark, sf_dir):
    b = tables(spark, sf_dir)["title_basics"]
    return b.select("tconst", COL.release_year_cast("startYear", "parity").alias("releaseYear"))


_YR_TXT = ("case when p_partkey % 13 = 0 then null when p_partkey % 17 = 0 then 'n/a' "
           "else cast(2000 + p_partkey % 24 as varchar) || '.0' end")


@query("release_year_cast_lenient", f"select p_partkey, cast(try_cast(({_YR_TXT}) as double) as bigint) as releaseYear "
       "from part")
def q_release_year_cast_lenient(spark, sf_dir):
    p = tables(spark, sf_dir)["part"]
    txt = (F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).when(F.col("p_partkey") % 17 == 0, F.lit("n/a"))
           .otherwise(F.concat((2000 + F.col("p_partkey") % 24).cast("string"), F.lit(".0"))))
    return p.select("p_partkey", COL.release_year_cast(txt, "lenient").alias("releaseYear"))


@query("to_datetime_coerce", "select event_id, try_cast(case when event_id % 9 = 0 then 'garbage' "
       "else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp) as ts from events")
def q_to_datetime_coerce(spark, sf_dir):
    e = tables(spark, sf_dir)["events"]
    txt = F.when(F.col("event_id") % 9 == 0, F.lit("garbage")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", COL.to_datetime_coerce(txt).alias("ts"))


@query("normalize_columns", "select tconst as title_id, primaryTitle from title_basics")
def q_normalize_columns(spark, sf_dir):
    return COL.normalize_columns(tables(spark, sf_dir)["title_basics"]).select("title_id", "primaryTitle")


@query("rename_alias", "select tconst as title_id, startYear as releaseYear from title_basics")
def q_rename_alias(spark, sf_dir):
    return COL.rename_alias(tables(spark, sf_dir)["title_basics"]).select("title_id", "releaseYear")


@query("ensure_columns", "select tconst, cast(null as bigint) as numVotes, cast(null as double) as averageRating "
       "from title_basics")
def q_ensure_columns(spark, sf_dir):
    return COL.ensure_columns(tables(spark, sf_dir)["title_basics"]).select("tconst", "numVotes", "averageRating")


@query("require_columns", "select count(*) as rows from licensing")
def q_require_columns(spark, sf_dir):
    lic = COL.require_columns(tables(spark, sf_dir)["licensing"], ["license_id", "title", "release_year"], "base")
    return lic.agg(F.count(F.lit(1)).alias("rows"))


def q_preferred_column_order(spark, sf_dir):
    """Column order of a licensing frame with two pv_ columns, as (position, column)."""
    lic = tables(spark, sf_dir)["licensing"].withColumns({"pv_7d": F.col("units"), "pv_30d": F.col("price"),
                                                          "has_entity": F.lit(1)})
    cols = COL.preferred_column_order(lic).columns
    return lic.sparkSession.createDataFrame(list(enumerate(cols)), "position int, column string")


def q_select_dtypes(spark, sf_dir):
    return COL.dtypes_table(tables(spark, sf_dir)["licensing"])


_SEASON = "[0.8, 0.85, 1.0, 1.0, 1.05, 1.1, 1.15, 1.15, 1.1, 1.05, 1.0, 0.85]"


@query("reference_price",
       "with tb as (select territory, quantile_cont(price, 0.5) as base_price from licensing group by territory), "
       "x as (select l.license_id, tb.base_price, units, window_start, "
       "greatest(0.0, cast(date_diff('day', make_date(cast(coalesce(release_year, year(window_start)) as integer), 1, 1), "
       "cast(window_start as date)) as double)) as days from licensing l left join tb on l.territory = tb.territory) "
       f"select license_id, round(greatest(0.0, base_price * list_extract({_SEASON}, month(window_start)) * "
       "(1.0 + 0.25 * exp(-ln(2.0) * days / greatest(1.0, 180.0)))) * (1.0 - 0.12 * least(1.0, "
       "ln(1 + coalesce(units, 0.0)) / 10.0)), 0) as reference_price from x")
def q_reference_price(spark, sf_dir):
    """Checked at whole currency units: exp/ln differ in the last bit between engines."""
    lic = tables(spark, sf_dir).stored("licensing", ["license_id", "territory", "window_start", "release_year", "units", "price"])
    return reference_price(lic, places=0).select("license_id", "reference_price")


@query("pct_rank_avg", "select license_id, round((rank() over (partition by territory order by price) + "
       "(count(*) over (partition by territory, price) - 1) / 2.0) / count(price) over (partition by territory), 6) "
       "as pct from licensing")
def q_pct_rank_avg(spark, sf_dir):
    lic = tables(spark, sf_dir)["licensing"]
    return rnd(lic.select("license_id", "territory", "price").transform(
        lambda d: RK.pct_rank_by(d, "price", ["territory"], "pct")).select("license_id", "pct"))


_PB_SQL = ("with j as (select l.license_id, coalesce(l.units, 0.0) as pv, coalesce(cast(r.numVotes as double), 0.0) as v "
           "from licensing l left join title_ratings r on l.title_id = r.tconst) "
           "select license_id, round(((rank() over (order by pv) + (count(*) over (partition by pv) - 1) / 2.0) / "
           "count(*) over ()) * 0.6 + ((rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0) / "
           "count(*) over ()) * 0.4, 6) as popularity_blend from j")


@query("popularity_blend", _PB_SQL)
def q_popularity_blend(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = t["licensing"].join(t["title_ratings"].select(F.col("tconst").alias("title_id"), "numVotes"), "title_id", "left")
    j = j.select("license_id", F.col("units").alias("pv_30d"), "numVotes")
    return rnd(RK.popularity_blend(j).select("license_id", "popularity_blend"))


@query("score_metadata", f"with {S.linkage_ctes('intended', 'er')} select k_year, k_iso2, title_id as best_title_id, "
       "round(meta_score, 6) as meta_score from win")
def q_score_metadata(spark, sf_dir):
    t = tables(spark, sf_dir)
    cat = build_catalogue(t["title_basics"], t["title_ratings"], t["title_akas"], store=True)
    base = L.linkage_columns(prepare_base(t["licensing"]))
    rest = L.unmatched(base, L.id_entity_map(base, cat.core, "intended"))
    cfg = L.LinkageConfig()
    winners = L.score_blocks(L.block_keys(rest, cfg), cat.cand, cfg)
    return rnd(winners)


@query("preview", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem "
       "order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 10")
def q_preview(spark, sf_dir):
    li = tables(spark, sf_dir)["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return RK.preview(li, 10, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("topk", "select c_custkey, round(c_acctbal, 6) as c_acctbal from customer order by c_acctbal desc, c_custkey limit 15")
def q_topk(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select("c_custkey", "c_acctbal")
    return rnd(RK.topk(c, 15, [F.desc("c_acctbal"), "c_custkey"]))


@query("union_all", f"with {S.CORE.strip()},{S.AKAS} select title_id, primary_title_norm as title_norm, releaseYear, "
       "numVotes, cast(null as varchar) as region, cast(null as varchar) as language from core union all "
       "select a.title_id, a.aka_title_norm, c.releaseYear, c.numVotes, a.region, a.language from akas a "
       "left join core c on a.title_id = c.title_id")
def q_union_all(spark, sf_dir):
    t = tables(spark, sf_dir)
    cat = build_catalogue(t["title_basics"], t["title_ratings"], t["title_akas"])
    core = cat.core.select("title_id", F.col("primary_title_norm").alias("title_norm"), "releaseYear", "numVotes")
    ak = cat.akas.withColumnRenamed("aka_title_norm", "title_norm").join(
        cat.core.select("title_id", "releaseYear", "numVotes"), "title_id", "left")
    return RK.union_all(core, ak)


@query("distinct", "select distinct l_returnflag, l_linestatus, l_tax from lineitem")
def q_distinct(spark, sf_dir):
    return RK.distinct(tables(spark, sf_dir)["lineitem"].select("l_returnflag", "l_linestatus", "l_tax"))


@query("scatter_sample", "select round(cast(units as double), 6) as x, round(price, 6) as y from licensing "
       "where units is not null and price is not null")
def q_scatter_sample(spark, sf_dir):
    return rnd(R.scatter_sample(tables(spark, sf_dir)["licensing"], "units", "price"))


@query("scatter_sample_capped", "select round(cast(units as double), 6) as x, round(price, 6) as y from licensing "
       "where units is not null and price is not null order by md5(license_id || '|42'), 1, 2 limit 2000")
def q_scatter_sample_capped(spark, sf_dir):
    """Sampling operator: a deterministic hash sample of at most 2000 points."""
    return rnd(R.scatter_sample(tables(spark, sf_dir)["licensing"], "units", "price", max_points=2000, key=["license_id"]))


# ---------------------------------------------------------------- report bundles (rows-only)

def _pred(spark, sf_dir):
    from marquee.plans.q_model import predictions_long
    return predictions_long(spark, sf_dir)


@query("report_eda")
def q_report_eda(spark, sf_dir):
    return R.section_values(R.report_eda(tables(spark, sf_dir).stored("licensing")))


@query("report_visual")
def q_report_visual(spark, sf_dir):
    return R.section_values(R.report_visual(tables(spark, sf_dir)["licensing"]))


@query("report_model")
def q_report_model(spark, sf_dir):
    return R.section_values(R.report_model(_pred(spark, sf_dir)))


@query("report_full")
def q_report_full(spark, sf_dir):
    return R.section_values(R.report_full(tables(spark, sf_dir).stored("licensing"), _pred(spark, sf_dir), "run1"))


@query("eda_profile")
def q_eda_profile(spark, sf_dir):
    return R.section_values(R.eda_profile(tables(spark, sf_dir)["licensing"]))
