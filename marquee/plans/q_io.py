"""Queries: scans, sinks (round trips through the shared scratch folder), artefact catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.session import scratch_path
from marquee.sources import artifacts as A
from marquee.sources import io as IO
from marquee.sources.runstore import RunStore
from marquee.plans.registry import query, rnd, tables

_CUST_SQL = ("select c_custkey, c_name, case when c_custkey % 10 = 0 then null else c_acctbal end as c_acctbal, "
             "c_mktsegment from customer")


def _customer(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"]
    return c.select("c_custkey", "c_name",
                    F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    "c_mktsegment")


def _typed(df):
    return rnd(df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_name").cast("string"),
                         F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_mktsegment").cast("string")))


_CUST_ORACLE = ("select c_custkey, c_name, round(c_acctbal, 6) as c_acctbal, c_mktsegment from (" + _CUST_SQL + ") t")


@query("scan_parquet", "select l_orderkey, l_partkey, round(l_extendedprice, 6) as l_extendedprice from lineitem")
def q_scan_parquet(spark, sf_dir):
    li = IO.read_parquet(spark, f"{sf_dir}/lineitem")
    return rnd(li.select("l_orderkey", "l_partkey", "l_extendedprice"))


@query("scan_head", "select l_orderkey, l_linenumber, l_partkey from lineitem "
       "order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 50000")
def q_scan_head(spark, sf_dir):
    li = IO.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return IO.scan_head(li, 50_000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("scan_head_source_order", "select l_orderkey, l_linenumber, l_partkey from lineitem limit 50000")
def q_scan_head_source_order(spark, sf_dir):
    return IO.scan_head(IO.read_parquet(spark, f"{sf_dir}/lineitem.parquet"), 50_000, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("scan_csv", _CUST_ORACLE)
def q_scan_csv(spark, sf_dir):
    p = scratch_path(spark, "customer.csv")
    _customer(spark, sf_dir).write.option("header", True).csv(p)
    return _typed(IO.read_csv(spark, p))


@query("scan_tsv", _CUST_ORACLE)
def q_scan_tsv(spark, sf_dir):
    p = scratch_path(spark, "customer.tsv.gz")
    (_customer(spark, sf_dir).write.option("header", True).option("sep", "\t").option("nullValue", "\\N")
     .option("compression", "gzip").csv(p))
    return _typed(IO.read_tsv(spark, p))


@query("scan_json", _CUST_ORACLE)
def q_scan_json(spark, sf_dir):
    p = scratch_path(spark, "customer.json")
    _customer(spark, sf_dir).write.json(p)
    return _typed(IO.read_json(spark, p))


@query("scan_by_suffix", "select ext, count(*) as rows from (select 'parquet' as ext from customer union all "
       "select 'csv' from customer union all select 'tsv' from customer union all select 'json' from customer) t group by ext")
def q_scan_by_suffix(spark, sf_dir):
    c = _customer(spark, sf_dir)
    parts = []
    for ext, writer in [("parquet", lambda w, p: w.parquet(p)), ("csv", lambda w, p: w.option("header", True).csv(p)),
                        ("tsv", lambda w, p: w.option("header", True).option("sep", "\t").csv(p)),
                        ("json", lambda w, p: w.json(p))]:
        p = scratch_path(spark, f"customer.{ext}")
        writer(c.write, p)
        parts.append(IO.read_any(spark, p)
                     .select(F.lit(ext).alias("ext")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("ext").agg(F.count(F.lit(1)).alias("rows"))


@query("ingest_raw", _CUST_ORACLE)
def q_ingest_raw(spark, sf_dir):
    src = scratch_path(spark, "customer_export.tsv.gz")
    (_customer(spark, sf_dir).write.option("header", True).option("sep", "\t").option("nullValue", "\\N")
     .option("compression", "gzip").csv(src))
    root = scratch_path(spark, "raw")
    path = IO.ingest_raw(spark, src, root, "20240101-000000_run00001")
    return _typed(spark.read.parquet(path))


_TERR_AGG = ("select territory, count(*) as licences, round(sum(price), 6) as revenue from licensing group by territory")


@query("sink_parquet", _TERR_AGG)
def q_sink_parquet(spark, sf_dir):
    lic = tables(spark, sf_dir)["licensing"]
    agg = lic.groupBy("territory").agg(F.count(F.lit(1)).alias("licences"), F.sum("price").alias("revenue"))
    root = scratch_path(spark, "processed")
    path = IO.write_parquet(agg, root, "run1", "territory_revenue")
    return rnd(spark.read.parquet(path))


@query("sink_csv", _TERR_AGG)
def q_sink_csv(spark, sf_dir):
    lic = tables(spark, sf_dir)["licensing"]
    agg = lic.groupBy("territory").agg(F.count(F.lit(1)).alias("licences"), F.sum("price").alias("revenue"))
    path = IO.write_csv(agg, scratch_path(spark, "reports"), "run1", "territory_revenue")
    back = IO.read_csv(spark, path, schema="territory string, licences long, revenue double")
    return rnd(back)


@query("sink_json", _TERR_AGG)
def q_sink_json(spark, sf_dir):
    lic = tables(spark, sf_dir)["licensing"]
    agg = lic.groupBy("territory").agg(F.count(F.lit(1)).alias("licences"), F.sum("price").alias("revenue"))
    path = IO.write_json(agg, scratch_path(spark, "profiles"), "run1", "territory_revenue", "20240101_0000")
    back = IO.read_json(spark, path, schema="territory string, licences long, revenue double")
    return rnd(back)


# ---------------------------------------------------------------- artefact catalogue (listing derived from orders)

_LISTING_SQL = (
    "listing as (select case o_orderstatus when 'F' then 'processed' when 'O' then 'raw' else 'models' end as root, "
    "strftime(o_orderdate, '%Y%m%d-%H%M%S') || '_' || lpad(cast(o_custkey as varchar), 8, '0') as run_id, "
    "case o_orderpriority when '1-URGENT' then 'feature_master_cleaned_' || cast(o_orderkey as varchar) || '.parquet' "
    "when '2-HIGH' then 'feature_master_' || cast(o_orderkey as varchar) || '.parquet' "
    "when '3-MEDIUM' then 'metrics_' || cast(o_orderkey as varchar) || '.json' "
    "when '4-NOT SPECIFIED' then 'predictions_' || cast(o_orderkey as varchar) || '.csv' "
    "else 'licensing_deals.parquet' end as name from orders)")


def listing_from_orders(spark, sf_dir):
    o = tables(spark, sf_dir)["orders"]
    k = F.col("o_orderkey").cast("string")
    name = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("feature_master_cleaned_"), k, F.lit(".parquet")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("feature_master_"), k, F.lit(".parquet")))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("metrics_"), k, F.lit(".json")))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("predictions_"), k, F.lit(".csv")))
            .otherwise(F.lit("licensing_deals.parquet")))
    root = (F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "raw")
            .otherwise("models"))
    run = F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("_"),
                   F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return o.select(root.alias("root"), run.alias("run_id"), name.alias("name"))


@query("artifact_latest", f"with {_LISTING_SQL} select run_id, max(name) as latest from listing "
       "where starts_with(name, 'feature_master_') and ends_with(name, '.parquet') and not contains(name, 'cleaned') "
       "group by run_id")
def q_artifact_latest(spark, sf_dir):
    return A.artifact_latest(listing_from_orders(spark, sf_dir), "feature_master_", ".parquet", "cleaned")


@query("artifact_list", f"with {_LISTING_SQL} select run_id, name from listing where ends_with(lower(name), '.json') "
       "order by run_id, name")
def q_artifact_list(spark, sf_dir):
    return A.artifact_list(listing_from_orders(spark, sf_dir), ".json")


_CATALOG_SQL = (
    f"with {_LISTING_SQL}, cat as (select run_id, bool_or(root = 'raw') as has_raw, "
    "bool_or(root = 'processed' and starts_with(name, 'feature_master_') and ends_with(name, '.parquet') "
    "and not contains(name, 'cleaned')) as has_feature_master, "
    "bool_or(root = 'processed' and starts_with(name, 'feature_master_cleaned_') and ends_with(name, '.parquet')) "
    "as has_feature_master_cleaned, bool_or(root = 'models') as has_model from listing group by run_id) ")


@query("run_catalog", _CATALOG_SQL + "select * from cat order by run_id desc")
def q_run_catalog(spark, sf_dir):
    return A.run_catalog(listing_from_orders(spark, sf_dir))


@query("run_stage", _CATALOG_SQL +
       "select run_id, case when has_model then 'MODELED' when has_feature_master_cleaned then 'CLEANED' "
       "when has_feature_master then 'FEATURE_BUILT' when has_raw then 'STAGED' else 'EMPTY' end as stage, "
       "strptime(substr(replace(replace(run_id, '-', ''), '_', ''), 1, 14), '%Y%m%d%H%M%S') as created, "
       "strftime(strptime(substr(replace(replace(run_id, '-', ''), '_', ''), 1, 14), '%Y%m%d%H%M%S'), "
       "'%b %d, %Y %I:%M %p') as created_label from cat")
def q_run_stage(spark, sf_dir):
    return A.run_stage(A.run_catalog(listing_from_orders(spark, sf_dir)))


@query("model_artifacts")
def q_model_artifacts(spark, sf_dir):
    """Train, persist metrics / predictions / model, read back, re-predict."""
    from marquee.operators import model as M
    from marquee.operators import evaluate as EV
    li = tables(spark, sf_dir)["lineitem"].withColumn(
        "row_id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    tr, va = li.where(F.col("l_orderkey") % 5 != 0), li.where(F.col("l_orderkey") % 5 == 0)
    res = M.train_models(tr, "l_extendedprice", ["l_quantity", "l_discount"], "row_id",
                         [M.ModelSpec("LinearRegression", "linear", {})], valid=va)
    root = scratch_path(spark, "models")
    IO.write_csv(res.predictions, root, "run1", "predictions")
    IO.write_json(res.metrics, root, "run1", "metrics", "20240101_0000")
    store = RunStore(spark, scratch_path(spark, "runs"))
    run = store.begin("run1")
    run.put_model("LinearRegression", res.models["LinearRegression"])
    run.commit()
    back = store.activate("run1").models["LinearRegression"]
    data, _ = M.feature_target(va, "l_extendedprice", ["l_quantity", "l_discount"], "row_id")
    p = back.transform(data).select(F.col("row_id").alias("row_id"), F.lit("reloaded").alias("model"),
                                    F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    return rnd(EV.regression_metrics(p))
