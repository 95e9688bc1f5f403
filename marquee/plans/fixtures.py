"""Domain views over the driver tables.

The SQL text is the same for Spark and DuckDB, so an oracle query can put these
views in a ``WITH`` clause and run unchanged.  The views deliberately carry null
ids, null years, catalogue gaps, titles without ratings, one unmapped territory,
untidy titles and null units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.session import save_table

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

LICENSING_SQL = """
select concat('L', cast(l_orderkey as string), '-', cast(l_partkey as string), '-',
              cast(l_suppkey as string), '-', cast(l_linenumber as string)) as license_id,
       case when l_partkey % 7 = 0 then null
            else concat('tt', lpad(cast(l_partkey as string), 7, '0')) end as title_id,
       concat(' ', p_name, '__', p_brand, '! ') as title,
       case when l_partkey % 49 = 0 then null else 2000 + l_partkey % 24 end as release_year,
       case c_nationkey % 14 when 0 then 'USA' when 1 then 'GBR' when 2 then 'CAN' when 3 then 'AUS' when 4 then 'DEU' when 5 then 'IND' when 6 then 'FRA'
         when 7 then 'JPN' when 8 then 'ESP' when 9 then 'TUR' when 10 then 'RUS' when 11 then 'DNK' when 12 then 'SRB' else 'BRA' end as territory,
       c_mktsegment as media, p_brand as platform,
       o_orderdate as window_start, l_shipdate as window_end,
       case when l_linenumber = 3 then null else l_quantity end as units,
       l_extendedprice as price, 'USD' as currency
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join part on l_partkey = p_partkey
"""

TITLE_BASICS_SQL = """
select concat('tt', lpad(cast(p_partkey as string), 7, '0')) as tconst, p_type as titleType,
       p_name as primaryTitle,
       case when p_partkey % 13 = 0 then null else 2000 + p_partkey % 24 end as startYear,
       p_size as runtimeMinutes, p_brand as genres
from part where p_partkey % 11 <> 0
"""

TITLE_RATINGS_SQL = """
select concat('tt', lpad(cast(l_partkey as string), 7, '0')) as tconst,
       avg(l_quantity) / 5 as averageRating, count(*) as numVotes
from lineitem where l_partkey % 5 <> 0 group by l_partkey
"""

TITLE_AKAS_SQL = """
select distinct concat('tt', lpad(cast(l_partkey as string), 7, '0')) as titleId, upper(p_name) as title,
       case s_nationkey % 14 when 0 then 'US' when 1 then 'GB' when 2 then 'CA' when 3 then 'AU' when 4 then 'DE' when 5 then 'IN' when 6 then 'FR'
         when 7 then 'JP' when 8 then 'ES' when 9 then 'TR' when 10 then 'RU' when 11 then 'DK' when 12 then 'RS' else 'BR' end as region,
       cast(null as string) as language
from lineitem
join supplier on l_suppkey = s_suppkey
join part on l_partkey = p_partkey
"""

DOMAIN_VIEWS = {
    "licensing": LICENSING_SQL,
    "title_basics": TITLE_BASICS_SQL,
    "title_ratings": TITLE_RATINGS_SQL,
    "title_akas": TITLE_AKAS_SQL,
}

#: How Spark reads a view: the same rows, with the joins in an order that moves fewer of them. Deals are completed
#: before the lines join them, and the regions of a title are made distinct before its name is attached.
_SPARK_VIEWS = {
    "licensing": LICENSING_SQL.replace("""from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
""", """from lineitem
join (select o_orderkey, o_orderdate, c_nationkey, c_mktsegment from orders join customer on o_custkey = c_custkey) deals
  on l_orderkey = o_orderkey
"""),
    "title_akas": TITLE_AKAS_SQL.replace("""from lineitem
join supplier on l_suppkey = s_suppkey
""", """from (select distinct l_partkey, s_nationkey
      from (select /*+ REPARTITION(l_partkey) */ l_partkey, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey) x) offers
"""),
}


def with_views(sql: str, views: list[str] | None = None) -> str:
    """Prefix ``sql`` with the domain views as CTEs (for the DuckDB oracle)."""
    names = views if views is not None else [v for v in DOMAIN_VIEWS if v in sql]
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as ({DOMAIN_VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


class Tables:
    """Lazy access to the driver tables and the domain views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.raw(name)
        if name not in self._cache:
            sql = _SPARK_VIEWS.get(name, DOMAIN_VIEWS[name])
            used = {t: self.raw(t) for t in DRIVER_TABLES if _mentions(sql, t)}
            text = sql
            for t in used:
                text = _bind(text, t)
            self._cache[name] = self.spark.sql(text, **used)
        return self._cache[name]

    __getitem__ = view

    def stored(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """A view (or some of its columns) written once, for queries that read it several times."""
        df = self.view(name)
        return save_table(df.select(*columns) if columns else df, name)


def _mentions(sql: str, table: str) -> bool:
    import re
    return re.search(rf"\b(from|join)\s+{table}\b", sql) is not None


def _bind(sql: str, table: str) -> str:
    """Turn ``from t`` / ``join t`` into a DataFrame parameter ``{t}``."""
    import re
    return re.sub(rf"\b(from|join)\s+{table}\b", rf"\1 {{{table}}}", sql)
