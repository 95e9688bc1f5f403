"""Record linkage: catalogue assembly, id mapping, blocked metadata resolution.

Scale notes
-----------
* ``resolve_entities`` never loops over licences and never pairs licences with
  candidates.  The score depends only on the block key ``(release_year, iso2)``,
  so we (1) take the distinct block keys of the unmatched rows (bounded by
  years x territories), (2) pre-aggregate the
  candidates to ``(releaseYear, region, numVotes) -> count, min(title_id)``,
  (3) equi-join keys to the aggregated candidates on an exploded year key,
  (4) score each key's block with windows over aggregated rows, (5) pick the
  winner with ``min_by`` (partial aggregation, skew safe) and (6) attach the
  winners to the licences with a null-safe equi-join on the key.
* Null release years (no year test) and unmapped territories (no region test)
  collapse the matching dimension in the candidate roll-up instead of joining
  on a constant, so no nested-loop or cartesian join appears in the plan.
* Candidates are read once: the roll-up by (year, region, votes) is written, and
  the coarser ones that null years and unmapped territories need are rolled up
  from it. Windows run over a block's distinct (year, region, votes), not its titles.
* Most licence ids stand in one row, and that row alone decides their mapping. ``split_by_licence`` finds the ids
  that do not (8 bytes a row move) and linkage maps the other rows where they stand; rows of repeated or null ids
  are grouped and joined by licence. The single rows get their title's columns as the id map finds them, and a block's
  winner brings its own, so rows do not move by title again for the catalogue's columns.
* ``title_similarity_join`` finds pairs by shared segments, not by comparing all
  titles of a year.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.functions.columns import CORE_OPTIONAL, release_year_cast, rename_alias, require_columns
from marquee.functions.text import normalize_title, title_similarity
from marquee.session import save_table


@dataclass(frozen=True)
class LinkageConfig:
    contingency_year: int = 1
    min_similarity_score: float = 0.88
    # fixed values: ISO-3 territory -> ISO-2 region
    iso3_to_iso2: dict = field(default_factory=lambda: {
        "USA": "US", "GBR": "GB", "CAN": "CA", "AUS": "AU", "DEU": "DE", "IND": "IN",
        "FRA": "FR", "JPN": "JP", "ESP": "ES", "TUR": "TR", "RUS": "RU", "DNK": "DK",
        "SRB": "RS"})
    # fixed values: method ranks
    method_rank: dict = field(default_factory=lambda: {
        "id_exact": 5, "exact_title_norm_year": 4, "exact_title_norm": 3,
        "meta_year_region_votes": 2, "fuzzy_title_norm_year": 1, "no_match": 0})


REPEATED_IDS = 1_000_000     # hashes of repeated licence ids that are sent to every task, 8 bytes each

META_METHOD = "meta_year+region+votes"
MAPPING_COLUMNS = ["license_id", "title_id", "method", "match_score"]


# ---------------------------------------------------------------- catalogue

def catalog_core(basics: DataFrame | None, ratings: DataFrame | None,
                 year_mode: str = "parity") -> DataFrame:
    """Title catalogue: one select over basics and ratings (either may be absent).

    The derived columns are declared below by name; all others pass through as they are.
    """
    given = [t for t in (basics, ratings) if t is not None]
    if not given:
        raise ValueError("catalogue needs basics or ratings")
    joined = given[0] if len(given) == 1 else given[0].join(given[1], "tconst", "left")
    have = set(joined.columns)
    title = next((F.col(c) for c in ("primaryTitle", "primary_title") if c in have), F.lit(None).cast("string"))
    year = release_year_cast("startYear", year_mode) if "startYear" in have and "releaseYear" not in have else None
    declared = {"title_id": F.col("tconst"), "primaryTitle": title, "primary_title_norm": normalize_title(title)}
    if year is not None:
        declared["releaseYear"] = year
    read = {"tconst", "primary_title" if "primaryTitle" not in have else "", "startYear" if year is not None else ""}
    through = [c for c in joined.columns if c not in read and c not in declared]
    absent = {c: F.lit(None).cast(t) for c, t in CORE_OPTIONAL.items() if c not in declared and c not in through}
    return joined.select(*through, *[e.alias(c) for c, e in {**absent, **declared}.items()])


def catalog_akas(akas: DataFrame) -> DataFrame:
    """Distinct (title_id, aka_title_norm, region, language)."""
    return (akas.select(F.col("titleId").alias("title_id"),
                        normalize_title("title").alias("aka_title_norm"),
                        "region", "language")
            .distinct())


def candidate_universe(core: DataFrame, akas: DataFrame) -> DataFrame:
    """core titles UNION (akas LEFT JOIN core years/votes), null title_norm dropped, distinct."""
    cand_core = core.select("title_id", F.col("primary_title_norm").alias("title_norm"),
                            "releaseYear", "numVotes")
    cand_akas = (akas.withColumnRenamed("aka_title_norm", "title_norm")
                 .join(core.select("title_id", "releaseYear", "numVotes"), "title_id", "left"))
    return (cand_core.unionByName(cand_akas, allowMissingColumns=True)
            .dropna(subset=["title_norm"]).distinct())


# ---------------------------------------------------------------- id mapping

def split_by_licence(base: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose licence id stands in no other row, rows of repeated and null ids); None for a part without rows.

    ``base`` is a written table, as it is read up to three times. Ids are counted by a hash: rows of two ids with the same hash count
    as repeated. With more than ``REPEATED_IDS`` such hashes, all rows count as repeated.
    """
    licence = F.xxhash64("license_id")
    rows = F.sum(F.when(F.col("license_id").isNull(), 2).otherwise(1))      # a null id is never a single one
    repeated = save_table(base.groupBy(licence.alias("_licence")).agg(rows.alias("n")).where("n > 1").select("_licence"), "repeated")
    n = repeated.count()
    if n == 0:
        return base, None
    if n > REPEATED_IDS:
        return None, base
    same = licence == F.col("_licence")
    return base.join(F.broadcast(repeated), same, "left_anti"), base.join(F.broadcast(repeated), same, "left_semi")


def id_entity_map(base: DataFrame, core: DataFrame | None = None, mode: str = "intended", carry: list[str] | None = None,
                  titles: DataFrame | None = None) -> DataFrame:
    """Licences carrying a title id -> (license_id, title_id, 'id_exact', 1.0).

    ``intended`` keeps only ids present in the catalogue (left-semi join);
    ``parity`` keeps every non-null id, as the reference's self-keyed left merge does.
    ``carry``: licences stand in one row each, so rows are distinct as they are, and these columns come along.
    ``titles``: the catalogue with one row a title; with ``carry``, its columns come along, too.
    """
    require_columns(base, ["license_id", "title_id"], "base")
    hits = base.where(F.col("title_id").isNotNull())
    if mode == "intended":
        if core is None:
            raise ValueError("intended id mapping needs the catalogue")
        if titles is None:
            hits = hits.join(core.select("title_id"), "title_id", "left_semi")
    if titles is not None:
        hits = hits.join(titles, "title_id", "inner" if mode == "intended" else "left")
    along = _title_columns(titles)
    found = hits.select("license_id", "title_id").distinct() if carry is None else hits.select("license_id", "title_id", *carry, *along)
    return (found.withColumns({"method": F.lit("id_exact"), "match_score": F.lit(1.0)}))


def _title_columns(titles: DataFrame | None) -> list[str]:
    return [c for c in titles.columns if c != "title_id"] if titles is not None else []


def unmatched(base: DataFrame, id_map: DataFrame) -> DataFrame:
    """Base rows whose licence has no id mapping."""
    return base.join(id_map.select("license_id"), "license_id", "left_anti")


# ---------------------------------------------------------------- metadata resolution

def _iso2(territory: Column, cfg: LinkageConfig) -> Column:
    m = F.create_map(*[F.lit(x) for kv in sorted(cfg.iso3_to_iso2.items()) for x in kv])
    return F.element_at(m, F.upper(F.coalesce(territory.cast("string"), F.lit("NONE"))))


def block_keys(rows: DataFrame, cfg: LinkageConfig) -> DataFrame:
    """Distinct block keys ``(k_year, k_iso2)`` of licence rows."""
    return rows.select(F.col("release_year").cast("bigint").alias("k_year"),
                       _iso2(F.col("territory"), cfg).alias("k_iso2")).distinct()


def candidate_rollup(cand: DataFrame) -> DataFrame:
    """Candidates by (year, region, votes) with their count and least title id, written once."""
    c = cand.select(F.col("releaseYear").cast("bigint").alias("c_year"),
                    F.col("region").alias("c_region"),
                    F.col("numVotes").cast("bigint").alias("c_votes"), "title_id")
    return save_table(c.groupBy("c_year", "c_region", "c_votes").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("title_id").alias("best_id")), "candidates")


def score_blocks(keys: DataFrame, cand: DataFrame, cfg: LinkageConfig, rollup: DataFrame | None = None):
    """Best candidate per block key: (k_year, k_iso2, best_title_id, meta_score).

    Keys whose block is empty get no row. ``rollup``: the candidates' roll-up where it is written already.
    """
    n = cfg.contingency_year
    # candidate roll-ups: every block reads one of them through an equi-join
    lattice = candidate_rollup(cand) if rollup is None else rollup
    by_year_region = lattice.where(F.col("c_year").isNotNull())

    kb = save_table(keys, "keys")     # read by every branch below; its size is known to the planner

    ky = F.col("k_year")
    kr = F.col("k_iso2")
    region_slots = F.array(F.lit("\u0000"), kr)          # "\0" marks a null-region candidate
    rmark = F.coalesce(F.col("c_region"), F.lit("\u0000"))

    # 1. year known, region known: year +-n and region in {null, iso2}
    k1 = (kb.where(ky.isNotNull() & kr.isNotNull())
          .withColumn("j_year", F.explode(F.sequence(ky - n, ky + n)))
          .withColumn("j_region", F.explode(region_slots)))
    b1 = k1.join(by_year_region.withColumns({"j_year": F.col("c_year"), "j_region": rmark}),
                 ["j_year", "j_region"])
    b1 = b1.select("k_year", "k_iso2", "c_year", "c_region", "c_votes", "cnt", "best_id")

    # 2. year known, territory unmapped: any region
    k2 = kb.where(ky.isNotNull() & kr.isNull()).withColumn("j_year", F.explode(F.sequence(ky - n, ky + n)))
    b2 = k2.join(by_year_region.withColumn("j_year", F.col("c_year")), "j_year").select(
        "k_year", "k_iso2", "c_year", "c_region", "c_votes", "cnt", "best_id")

    # 3./4. no year test: release year irrelevant, so roll it up
    by_region = lattice.groupBy("c_region", "c_votes").agg(
        F.sum("cnt").alias("cnt"), F.min("best_id").alias("best_id"))
    k3 = kb.where(ky.isNull() & kr.isNotNull()).withColumn("j_region", F.explode(region_slots))
    b3 = k3.join(by_region.withColumn("j_region", rmark), "j_region").select(
        "k_year", "k_iso2", F.lit(None).cast("bigint").alias("c_year"), "c_region", "c_votes",
        "cnt", "best_id")
    blocks = b1.unionByName(b2).unionByName(b3)
    # 4. neither test (at most one key): every candidate; only "has a region" matters
    if kb.where(ky.isNull() & kr.isNull()).limit(1).count() > 0:
        by_flag = lattice.groupBy(F.col("c_region").isNotNull().alias("has_region"), "c_votes").agg(
            F.sum("cnt").alias("cnt"), F.min("best_id").alias("best_id"))
        b4 = by_flag.select(
            F.lit(None).cast("bigint").alias("k_year"), F.lit(None).cast("string").alias("k_iso2"),
            F.lit(None).cast("bigint").alias("c_year"),
            F.when(F.col("has_region"), F.lit("*")).alias("c_region"), "c_votes", "cnt", "best_id")
        blocks = blocks.unionByName(b4)

    key = ["k_year", "k_iso2"]
    wk = Window.partitionBy(*key)
    v0 = F.coalesce(F.col("c_votes"), F.lit(0))
    # average-tie percentile rank of votes (nulls as 0) over the block, weighted by counts
    per_v = blocks.withColumn("v0", v0)
    peers = F.sum("cnt").over(Window.partitionBy(*key, "v0"))
    le = F.sum("cnt").over(wk.orderBy("v0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("cnt").over(wk)
    yr_pen = F.when(F.col("k_year").isNull(), F.lit(0.0)).otherwise(
        F.abs(F.col("c_year") - F.col("k_year")).cast("double"))
    scored = per_v.withColumns({"yr_pen": yr_pen, "pct": (le - (peers - 1) / 2.0) / total})
    mx = F.max("yr_pen").over(wk)
    denom = F.when(mx == 0, F.lit(1.0)).otherwise(mx)
    ratio = F.least(F.greatest(F.col("yr_pen") / denom, F.lit(0.0)), F.lit(1.0))
    region_bonus = F.col("c_region").isNotNull().cast("double") * 0.1
    meta = (1.0 - ratio) * 0.6 + F.col("pct") * 0.3 + region_bonus * 0.1
    scored = scored.withColumn("meta_score", meta)
    # winner: highest score, then most votes (null last), then smallest title id
    order = F.struct((-F.col("meta_score")).alias("a"),
                     F.col("c_votes").isNull().alias("b"),
                     (-F.coalesce(F.col("c_votes"), F.lit(0))).alias("c"),
                     F.col("best_id").alias("d"))
    winners = scored.groupBy(*key).agg(
        F.min_by(F.struct(F.col("best_id").alias("title_id"), "meta_score"), order).alias("w")
    ).select(*key, F.col("w.title_id").alias("best_title_id"), F.col("w.meta_score").alias("meta_score"))
    return winners


def resolve_entities(rows: DataFrame, cand: DataFrame, cfg: LinkageConfig = LinkageConfig(),
                     snapshot: bool = True, rollup: DataFrame | None = None, carry: list[str] | None = None,
                     keys: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """One mapping row per input row: best metadata match at or above the threshold, else no_match.

    ``carry``: columns of the rows that come along; ``rollup``: see ``score_blocks``. ``keys``: block keys, those of
    the rows among them, so that the rows need not be read for them. ``titles``: one row a title; the columns of
    a matched one come along.
    """
    carry = carry or []
    require_columns(rows, ["license_id", "release_year", "territory"], "base")
    require_columns(cand, ["title_id", "releaseYear", "numVotes", "region"], "cand")
    keyed = rows.select("license_id", F.col("release_year").cast("bigint").alias("k_year"), _iso2(F.col("territory"), cfg).alias("k_iso2"), *carry)
    if keys is None:
        # the rows are read for their keys and again for the winners: their narrow columns are written once
        keyed = save_table(keyed, "keyed")
        keys = keyed.select("k_year", "k_iso2").distinct()
    # one row a block: written, so that the planner knows that the rows need not move to it
    winners = save_table(score_blocks(keys, cand, cfg, rollup), "winners")
    if titles is not None:
        won = winners.select(F.col("best_title_id").alias("title_id"))
        named = titles.join(F.broadcast(won), "title_id", "left_semi").withColumnRenamed("title_id", "best_title_id")
        winners = save_table(winners.join(named, "best_title_id", "left"), "winners")
    joined = keyed.join(winners,
                        keyed.k_year.eqNullSafe(winners.k_year) & keyed.k_iso2.eqNullSafe(winners.k_iso2),
                        "left")
    ok = F.col("meta_score") >= F.lit(cfg.min_similarity_score)
    out = joined.select(
        "license_id", *carry,
        F.when(ok, F.col("best_title_id")).alias("title_id"),
        F.when(ok, F.lit(META_METHOD)).otherwise(F.lit("no_match")).alias("method"),
        F.when(ok, F.col("meta_score")).otherwise(F.lit(0.0)).alias("match_score"),
        *[F.when(ok, F.col(c)).alias(c) for c in _title_columns(titles)])
    if snapshot:
        out = out.withColumn("snapshot_date", F.date_format(F.current_date(), "yyyy-MM-dd"))
    return out


def linkage_columns(base: DataFrame) -> DataFrame:
    """The four columns that linkage reads, written once: the id map, its remainder and the block keys all read them."""
    return save_table(base.select("license_id", "title_id", "release_year", "territory"), "licences")


def entity_mapping(base: DataFrame, core: DataFrame, cand: DataFrame, cfg: LinkageConfig = LinkageConfig(), mode: str = "intended",
                   stored: bool = False, rollup: DataFrame | None = None, carry: list[str] | None = None,
                   titles: DataFrame | None = None) -> DataFrame:
    """Id map UNION metadata map of the rows the id map left. ``stored``: the base is a written table already.

    ``carry``: each licence of the base stands in one row and none is null. Then no row moves by its licence,
    and these columns come along, as do those of the mapped title in ``titles`` (a written catalogue with one row
    a title). ``rollup``: see ``score_blocks``.
    """
    if carry is not None:
        base = base.select("license_id", *dict.fromkeys(["title_id", "release_year", "territory", *carry]))
        idm = id_entity_map(base, core, mode, carry, titles)
        known = core if titles is None else titles
        rest = base.join(known.select("title_id"), "title_id", "left_anti") if mode == "intended" else base.where(F.col("title_id").isNull())
        er = resolve_entities(rest, cand, cfg, rollup=rollup, carry=carry, keys=block_keys(base, cfg), titles=titles)
        return idm.unionByName(er, allowMissingColumns=True)
    base = base.select("license_id", "title_id", "release_year", "territory") if stored else linkage_columns(base)
    idm = save_table(id_entity_map(base, core, mode), "matched")      # read for the union and for what it leaves
    # a row that matched by itself is not among the rest; only the others move to be compared with the map
    own = F.col("title_id").isNotNull() & F.col("license_id").isNotNull()
    if mode == "intended":
        known = core.select(F.col("title_id").alias("_known"))
        others = base.join(known, (F.col("title_id") == F.col("_known")) & F.col("license_id").isNotNull(), "left_anti")
    else:
        others = base.where(~own)
    er = resolve_entities(unmatched(others, idm), cand, cfg, rollup=rollup)
    return idm.unionByName(er, allowMissingColumns=True)


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """Counts per method and hit %."""
    return mapping.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("method") == "id_exact").alias("id_matches"),
        F.count_if(F.col("method") != "id_exact").alias("metadata_rows"),
        F.round(100.0 * F.avg(F.col("title_id").isNotNull().cast("double")), 6).alias("hit_pct"))


def method_rank_expr(cfg: LinkageConfig, mode: str = "intended") -> Column:
    """Rank of a method label; unknown -> 1.

    ``parity`` reproduces the reference's whole-value replace, under which
    ``meta_year+region+votes`` misses its key and ranks 1.
    """
    m = F.create_map(*[F.lit(x) for kv in sorted(cfg.method_rank.items()) for x in kv])
    label = F.col("method") if mode == "parity" else F.regexp_replace("method", r"\+", "_")
    return F.coalesce(F.element_at(m, label), F.lit(1))


def rank_entity_map(mapping: DataFrame, cfg: LinkageConfig = LinkageConfig(),
                    mode: str = "intended") -> DataFrame:
    """Best mapping row per licence: method rank desc, score desc, title id asc.

    The smallest struct that begins with the sort order is aggregated partially in each task (a sort
    aggregate, as rows hold strings), so a licence with very many rows is never gathered in one task,
    and each column moves once. Ties go to the smaller of the other columns.
    """
    cols = [c for c in mapping.columns if c != "license_id"]
    order = F.struct((-method_rank_expr(cfg, mode)).alias("_a"), (-F.col("match_score")).alias("_b"),
                     F.col("title_id").isNull().alias("_c"), "title_id", *[c for c in cols if c not in ("title_id", "match_score")])
    best = mapping.groupBy("license_id").agg(F.min(order).alias("w"))
    return best.select("license_id", *[(-F.col("w._b") if c == "match_score" else F.col(f"w.{c}")).alias(c) for c in cols])


# ---------------------------------------------------------------- title similarity

def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k nearly equal segments; the later ones are longer by one."""
    base, extra = F.floor(length / k), length % k
    start = 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - (k - extra))
    return start.cast("int"), (base + (i > k - extra).cast("int")).cast("int")


def _segments(length: Column, threshold: float) -> Column:
    """Segments of a title of that length: one more than the edits to any title that may be similar to it."""
    longest = F.floor(length / threshold + 1e-9)
    return (F.floor(longest * (1.0 - threshold) + 1e-9) + 1).cast("int")


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of distinct (j_year, l_title) and (j_year, r_title) that are at least ``threshold`` similar.

    Partition filter: within tau edits, one of tau + 1 segments of the right title stands
    unchanged in the left one, near its own place. Segments of right titles are equi-joined to
    the substrings of left titles at the places where the segment can lie (by its number and
    the titles' lengths), for each length a similar title can have. Only the candidates that
    share a segment are compared, so no plan pairs the titles of a year.
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError("threshold: more than 0.5, at most 1")
    i, n = F.col("i"), F.col("n")
    r = right.select("j_year", "r_title").distinct().withColumn("n", F.length("r_title")).withColumn("k", _segments(n, threshold))
    r = r.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    at, size = _segment(n, F.col("k"), i)
    r = r.select(F.xxhash64("j_year", "n", "i", F.substring("r_title", at, size)).alias("key"), F.col("j_year").alias("r_year"), "r_title")
    here = F.length("l_title")
    s = left.select("j_year", "l_title").distinct().withColumn("n", F.explode(F.sequence(
        F.ceil(here * threshold - 1e-9).cast("int"), F.floor(here / threshold + 1e-9).cast("int"))))
    s = s.withColumn("k", _segments(n, threshold)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    at, size = _segment(n, F.col("k"), i)
    s = s.withColumn("at", at).withColumn("size", size)
    shift, left_of, right_of = F.length("l_title") - n, i - 1, F.col("k") - i
    first = F.greatest(F.lit(1), F.col("at") - left_of, F.col("at") + shift - right_of)
    last = F.least(F.length("l_title") - F.col("size") + 1, F.col("at") + left_of, F.col("at") + shift + right_of)
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    s = s.withColumn("x", F.explode(places))
    s = s.select(F.xxhash64("j_year", "n", "i", F.substring("l_title", F.col("x"), F.col("size"))).alias("key"), "j_year", "l_title").distinct()
    pairs = (s.join(r, "key").where(F.col("j_year") == F.col("r_year")).select("j_year", "l_title", "r_title").distinct())
    return pairs.withColumn("similarity", title_similarity("l_title", "r_title")).where(F.col("similarity") >= threshold)


def title_similarity_join(left: DataFrame, right: DataFrame, threshold: float = 0.9,
                          year_slack: int = 0) -> DataFrame:
    """Pairs (license_id, title_id, similarity) within the same release year (+-slack)
    whose normalised titles are at least ``threshold`` (over 0.5) similar.

    Similarity is 1 - edit distance / longer length. Distinct titles are paired first
    (``similar_titles``); ids join on their titles. Rows without year or title have no pair.
    """
    lrows = left.select("license_id", F.col("title_norm").alias("l_title"),
                        F.col("release_year").cast("bigint").alias("l_year")).dropna()
    lrows = lrows.withColumn("j_year", F.explode(F.sequence(F.col("l_year") - year_slack, F.col("l_year") + year_slack)))
    rrows = right.select("title_id", F.col("title_norm").alias("r_title"),
                         F.col("releaseYear").cast("bigint").alias("j_year")).dropna().distinct()
    pairs = similar_titles(lrows, rrows, threshold)
    return (lrows.join(pairs, ["j_year", "l_title"]).join(rrows, ["j_year", "r_title"])
            .select("license_id", "title_id", F.round("similarity", 6).alias("similarity")).distinct())
