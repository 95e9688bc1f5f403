"""SQL fragments for the DuckDB oracle (independent re-statements of each operator)."""

from __future__ import annotations


def norm_title(x: str) -> str:
    s = f"lower(coalesce(cast({x} as varchar), ''))"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '_+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


def iso2(x: str) -> str:
    pairs = [("USA", "US"), ("GBR", "GB"), ("CAN", "CA"), ("AUS", "AU"), ("DEU", "DE"),
             ("IND", "IN"), ("FRA", "FR"), ("JPN", "JP"), ("ESP", "ES"), ("TUR", "TR"),
             ("RUS", "RU"), ("DNK", "DK"), ("SRB", "RS")]
    arms = " ".join(f"when '{a}' then '{b}'" for a, b in pairs)
    return f"(case upper(coalesce({x}, 'NONE')) {arms} end)"


D = "cast({} as double)".format

CORE = f"""
core as (
  select b.tconst as title_id, b.titleType, b.primaryTitle, b.runtimeMinutes, b.genres,
         r.averageRating, r.numVotes, cast(coalesce(b.startYear, 0) as bigint) as releaseYear,
         {norm_title('b.primaryTitle')} as primary_title_norm
  from title_basics b left join title_ratings r on b.tconst = r.tconst)"""

AKAS = f"""
akas as (
  select distinct titleId as title_id, {norm_title('title')} as aka_title_norm, region, language
  from title_akas)"""

CAND = """
cand as (
  select distinct * from (
    select title_id, primary_title_norm as title_norm, releaseYear, numVotes,
           cast(null as varchar) as region, cast(null as varchar) as language from core
    union all
    select a.title_id, a.aka_title_norm, c.releaseYear, c.numVotes, a.region, a.language
    from akas a left join core c on a.title_id = c.title_id) t
  where title_norm is not null)"""

BASE = f"""
base as (select *, {norm_title('title')} as title_norm from licensing)"""


def idmap(mode: str) -> str:
    cond = " and title_id in (select title_id from core)" if mode == "intended" else ""
    return f"""
idmap as (
  select distinct license_id, title_id, 'id_exact' as method, {D('1.0')} as match_score
  from base where title_id is not null{cond})"""


UNM = """
unm as (select * from base where license_id not in (select license_id from idmap))"""

ER = f"""
ukeys as (select distinct cast(release_year as bigint) as k_year, {iso2('territory')} as k_iso2 from unm),
blk as (
  select k.k_year, k.k_iso2, c.title_id, c.releaseYear, c.region, c.numVotes,
         case when k.k_year is null then {D('0')} else {D('abs(c.releaseYear - k.k_year)')} end as yr_pen
  from ukeys k join cand c
    on (k.k_year is null or abs(c.releaseYear - k.k_year) <= 1)
   and (k.k_iso2 is null or c.region is null or c.region = k.k_iso2)),
sc as (
  select *,
    (rank() over (partition by k_year, k_iso2 order by coalesce(numVotes, 0))
       + (count(*) over (partition by k_year, k_iso2, coalesce(numVotes, 0)) - 1) / {D('2')})
       / count(*) over (partition by k_year, k_iso2) as pct,
    max(yr_pen) over (partition by k_year, k_iso2) as mx
  from blk),
sc2 as (
  select *, ({D('1')} - least(greatest(yr_pen / case when mx = 0 then {D('1')} else mx end, {D('0')}), {D('1')})) * {D('0.6')}
            + pct * {D('0.3')} + ((case when region is not null then {D('1')} else {D('0')} end) * {D('0.1')}) * {D('0.1')} as meta_score
  from sc),
win as (
  select * from (
    select *, row_number() over (partition by k_year, k_iso2
                                 order by meta_score desc, numVotes desc nulls last, title_id asc) as rn
    from sc2) t where rn = 1),
er as (
  select u.license_id,
         case when w.meta_score >= {D('0.88')} then w.title_id end as title_id,
         case when w.meta_score >= {D('0.88')} then 'meta_year+region+votes' else 'no_match' end as method,
         case when w.meta_score >= {D('0.88')} then w.meta_score else {D('0')} end as match_score
  from (select license_id, cast(release_year as bigint) as k_year, {iso2('territory')} as k_iso2 from unm) u
  left join win w on u.k_year is not distinct from w.k_year and u.k_iso2 is not distinct from w.k_iso2)"""

# fixed values: method ranks
_RANKS = {"id_exact": 5, "exact_title_norm_year": 4, "exact_title_norm": 3,
          "meta_year_region_votes": 2, "fuzzy_title_norm_year": 1, "no_match": 0}


def mrank(mode: str) -> str:
    lab = "method" if mode == "parity" else "replace(method, '+', '_')"
    arms = " ".join(f"when '{k}' then {v}" for k, v in _RANKS.items())
    return f"coalesce(case {lab} {arms} end, 1)"


def ranked(mode: str) -> str:
    return f"""
emap as (select license_id, title_id, method, match_score from idmap
         union all select license_id, title_id, method, match_score from er),
ranked as (
  select license_id, title_id, method, match_score from (
    select *, row_number() over (partition by license_id order by {mrank(mode)} desc,
                                 match_score desc, title_id asc nulls last) as rn
    from emap) t where rn = 1)"""


def linkage_ctes(mode: str, upto: str = "ranked") -> str:
    parts = [CORE, AKAS, CAND, BASE, idmap(mode), UNM, ER, ranked(mode)]
    names = ["core", "akas", "cand", "base", "idmap", "unm", "er", "ranked"]
    return ",".join(parts[: names.index(upto) + 1])


def feature_master_sql(mode: str) -> str:
    if mode == "parity":
        tid, known = "b.title_id", "fm.title_id"
        fm_from = "base b left join ranked m on b.license_id = m.license_id"
    else:
        tid, known = "coalesce(m.title_id, b.title_id)", "i.title_id"
        fm_from = "base b left join ranked m on b.license_id = m.license_id"
    return f"""
imdb as (select title_id, primaryTitle, primary_title_norm, releaseYear, titleType, averageRating, numVotes
         from core),
fm as (
  select b.license_id, b.title, b.release_year, b.territory, b.media, b.platform, b.window_start,
         b.window_end, b.units, b.price, b.currency, b.title_norm, m.method, m.match_score,
         {tid} as title_id
  from {fm_from}),
feature_master as (
  select fm.*, i.primaryTitle, i.primary_title_norm, i.releaseYear, i.titleType, i.averageRating,
         i.numVotes, coalesce(i.primaryTitle, fm.title) as title_final,
         ln(1 + {D('coalesce(i.numVotes, 0)')}) as log1p_numVotes,
         case when {known} is not null then 1 else 0 end as has_entity
  from fm left join imdb i on fm.title_id = i.title_id)"""
