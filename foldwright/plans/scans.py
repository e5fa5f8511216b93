"""Readers and writers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators import models
from foldwright.operators.rowindex import with_row_index
from foldwright.plans.inputs import FOLDED_ORDERS, folded_orders, order_measures, table, MEASURES, TARGET
from foldwright.plans.registry import query
from foldwright.session import scratch_path, stored
from foldwright.sources import logs, sinks, tables

DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"


@query(
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as day,
        o_orderpriority from orders"""
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders_csv")
    tables.write_csv(orders, path)
    read = tables.read_csv(spark, path, orders.schema)
    return read.withColumn("day", F.expr(DAY)).drop("o_orderdate")


@query("select doc_id, length(text)::int as n, md5(text) as digest from documents where text <> ''")
def csv_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks, through CSV files and back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "documents_csv")
    tables.write_csv(documents.repartition("doc_id"), path)
    read = tables.read_csv(spark, path, documents.schema, free_text=True).where("text <> ''")
    return read.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("select doc_id as id from labels")
def id_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    tables.write_ids(table(spark, sf_dir, "labels"), "doc_id", path)
    return tables.read_ids(spark, path, "id")


@query(
    """select doc_id as "Id", toxic as "TypeId",
        case quality when 1 then 'Compiler' when 0 then 'Simulation' end as "ComputationTypeId" from labels"""
)
def metadata_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("Id"),
        F.col("toxic").cast("string").alias("TypeId"),
        (2 - F.col("quality")).cast("string").alias("ComputationTypeId"),
    )
    path = scratch_path(spark, "metadata_csv")
    tables.write_csv(labels, path)
    return tables.recode_metadata(tables.read_csv(spark, path, "Id bigint, TypeId string, ComputationTypeId string"))


@query(
    """with lines as (
        select p_partkey, p_brand as feature, (25 - p_size) / 1000.0::double as importance from part
        where p_partkey % 10 <> 3 and p_partkey % 10 <> 4)
    select feature, arg_max(importance, p_partkey) as importance from lines where importance < -0.001 group by 1"""
)
def importance_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.important_features(_importance_log(spark, sf_dir))


@query(
    """select p_brand as feature, (25 - p_size) / 1000.0::double as importance from part
    where p_partkey % 10 <> 3 and p_partkey % 10 <> 4 and p_size > 26"""
)
def importance_log_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line under the threshold, a feature as often as it was logged."""
    return logs.important_feature_list(_importance_log(spark, sf_dir))


def _importance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    number = F.when(F.col("p_partkey") % 10 == 3, "n/a").otherwise(((25 - F.col("p_size")) / 1000).cast("string"))
    ends = F.when(F.col("p_partkey") % 10 == 4, ", cut").otherwise("")
    line = F.concat(
        F.lit("Feature "), "p_partkey", F.lit(", "), "p_brand", F.lit(" importance: "), number, ends
    )
    path = scratch_path(spark, "importance_log")
    part.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select(line.alias("value")).write.text(path)
    return logs.read_importance_log(spark, path)


RUNS = """
    select o_orderpriority as experiment, o_orderstatus as run_id, avg(o_totalprice) / 1e6 as mean_rmse,
        stddev_pop(o_totalprice) / 1e6 as std_rmse,
        case when o_orderstatus = 'P' then 'nan'::double else max(o_totalprice) / 1e6 end as test_rmse,
        count(*) as n_features
    from orders group by 1, 2
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("run_id"))
        .agg(
            (F.avg(price) / 1e6).alias("mean_rmse"),
            (F.stddev_pop(price) / 1e6).alias("std_rmse"),
            (F.max(price) / 1e6).alias("test_rmse"),
            F.count(F.lit(1)).alias("n_features"),
        )
        .withColumn("test_rmse", F.when(F.col("run_id") == "P", float("nan")).otherwise(F.col("test_rmse")))
        .withColumn("features", F.array("experiment", "run_id"))
        .withColumn(
            "params",
            F.create_map(
                F.lit("lgb"),
                F.create_map(F.lit("run"), F.col("run_id"), F.lit("depth"), F.length("experiment").cast("string")),
                F.lit("xgb"),
                F.create_map(F.lit("eta"), F.lit("0.1")),
            ),
        )
    )


@query(
    f"""select experiment, run_id, round(mean_rmse, 6) as mean_rmse, round(std_rmse, 6) as std_rmse,
        isnan(test_rmse) as no_test, n_features, experiment || ',' || run_id as features,
        length(experiment)::varchar as depth from ({RUNS})"""
)
def run_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, path = _runs(spark, sf_dir), scratch_path(spark, "runs")
    logs.append_runs(runs.where("run_id = 'F'"), path)
    logs.append_runs(runs.where("run_id <> 'F'"), path)
    return logs.read_runs(spark, path).select(
        "experiment",
        "run_id",
        F.round("mean_rmse", 6).alias("mean_rmse"),
        F.round("std_rmse", 6).alias("std_rmse"),
        F.isnan("test_rmse").alias("no_test"),
        "n_features",
        F.array_join("features", ",").alias("features"),
        F.col("params")["lgb"]["depth"].alias("depth"),
    )


@query(
    f"""select run, printf('%.4f', mean_rmse)::double as mean_rmse, printf('%.4f', std_rmse)::double as std_rmse,
        case when isnan(test_rmse) then null else printf('%.4f', test_rmse)::double end as test_rmse, n_features, depth,
        row_number() over (order by printf('%.4f', mean_rmse)::double, run)::int as place
    from (select *, experiment || '/' || run_id as run, length(experiment)::varchar as depth from ({RUNS}))"""
)
def run_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "run_text")
    columns = ["features", "params", "mean_rmse", "std_rmse", "test_rmse", "n_features"]
    record = logs.run_text(*[F.col(c) for c in columns])
    logs.write_run_text(_runs(spark, sf_dir).select(record), path)
    runs = logs.read_run_text(spark, path).withColumn("run", F.array_join("features", "/"))
    return with_row_index(runs, ["mean_rmse", "run"], "place").select(
        "run",
        "mean_rmse",
        "std_rmse",
        F.nanvl("test_rmse", F.lit(None)).alias("test_rmse"),
        "n_features",
        F.col("params")["lgb"]["depth"].alias("depth"),
        F.col("place").cast("int").alias("place"),
    )


@query(f"select o_orderkey, fold from ({FOLDED_ORDERS})")
def fold_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "folds")
    sinks.write_fold_files(folded_orders(spark, sf_dir), "o_orderkey", "fold", path)
    return sinks.read_fold_files(spark, path, "o_orderkey")


@query("select o_orderkey, round(o_totalprice / 1000, 6) as prediction from orders")
def submission_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "submission")
    predictions = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("prediction"))
    sinks.write_table(predictions, path)
    return spark.read.parquet(path).withColumn("prediction", F.round("prediction", 6))


@query(
    """select failure is null as "Succeeded", code as "ErrorType", failure as "ErrorName",
        case when failure is not null then left(repeat(o_orderstatus || ' failed ' || n || ' times; ', 500), 8000) end
            as "ErrorDetails"
    from (select o_orderstatus, count(*) as n from orders group by 1)
    left join (values ('F', 'SERVER_MISSING_ENDPOINT', 4), ('P', 'INVALID_SUBMISSION', 6)) k(s, failure, code)
        on s = o_orderstatus"""
)
def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").count()
    status = F.col("o_orderstatus")
    failed = counts.select(
        F.when(status == "F", "SERVER_MISSING_ENDPOINT").when(status == "P", "INVALID_SUBMISSION").alias("failure"),
        F.repeat(F.concat(status, F.lit(" failed "), "count", F.lit(" times; ")), F.lit(500)).alias("details"),
    )
    path = scratch_path(spark, "status")
    sinks.write_status(sinks.status_rows(failed), path)
    return sinks.read_status(spark, path)


@query("select distinct l_orderkey, true as same from lineitem")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fitted model predicts the same for each order after it was saved and loaded."""
    rows = models.with_vector(stored(order_measures(spark, sf_dir)), MEASURES)
    fitted = models.boosted(models.BOOSTED_SETTINGS["lgb"], TARGET, 1, n_estimators=2, max_depth=3).fit(rows)
    loaded = models.save_and_load(fitted).setPredictionCol("loaded")
    both = loaded.transform(fitted.transform(rows))
    return both.select("l_orderkey", (F.col("prediction") == F.col("loaded")).alias("same"))
