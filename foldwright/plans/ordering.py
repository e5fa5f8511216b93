"""Joins by id, positions, batches, set operations and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators import joins, metrics
from foldwright.operators.rowindex import permuted_column, with_batch, with_seeded_position
from foldwright.plans.inputs import (
    FOLDED_ORDERS,
    IMPORTANCES,
    SEED,
    folded_orders,
    importances,
    sql_hash32,
    table,
)
from foldwright.functions.numeric import hash32
from foldwright.plans.registry import query
from foldwright.streaming.predictors import union_batches as concat_batches


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def semi_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.keep_ids(documents, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_join_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.drop_ids(documents, table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query(
    """select d.doc_id, coalesce(case l.quality when 1 then 'good' when 0 then 'poor' end, 'unlabelled') as quality
    from documents d left join labels l on l.doc_id = d.doc_id"""
)
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("quality")
    )
    found = joins.lookup_or(documents, labels, F.col("doc_id") == F.col("name"), "quality", F.lit("unlabelled"))
    return found.select("doc_id", "quality")


POSITIONS = f"""select o_orderkey, o_custkey, o_totalprice,
    row_number() over (order by md5(o_orderkey::varchar || '|{SEED}'), o_orderkey) as position from orders"""


@query(f"select o_orderkey, position from ({POSITIONS})")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_seeded_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SEED)


@query(
    f"""select (position - 1) // 100 as batch_id, count(*) as n, min(o_orderkey) as low, max(o_orderkey) as high
    from ({POSITIONS}) group by 1"""
)
def batch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_seeded_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SEED)
    return with_batch(placed, "position", 100).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")
    )


@query(f"select o.o_orderkey, o.o_totalprice, p.position from orders o join ({POSITIONS}) p on p.o_orderkey = o.o_orderkey")
def attach_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return joins.attach_by_key(orders, with_seeded_position(orders.select("o_orderkey"), "o_orderkey", SEED), "o_orderkey")


@query(
    f"""select a.o_orderkey, b.o_totalprice as permuted from ({POSITIONS}) a join (select o_totalprice,
        row_number() over (order by md5(o_orderkey::varchar || '|{SEED}|o_totalprice'), o_orderkey) as position
        from orders) b using (position)"""
)
def permute_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return permuted_column(orders, "o_orderkey", "o_totalprice", SEED, "permuted").drop("o_totalprice")


@query(
    """select o_orderkey, case o_orderkey % 50 when 1 then 'missing' when 2 then 'duplicate' when 3 then 'null_prediction' end
        as issue from orders where o_orderkey % 50 in (1, 2, 3)
    union all select -o_orderkey - 1, 'extra' from orders where o_orderkey % 50 = 4"""
)
def reconcile_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    turn = F.col("o_orderkey") % 50
    copies = F.when(turn == 1, 0).when(turn == 2, 2).otherwise(1)
    given = orders.select(
        "o_orderkey",
        F.when(turn != 3, F.col("o_totalprice")).alias("prediction"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")
    extra = orders.where(turn == 4).select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(0.0).alias("prediction"))
    return joins.reconcile(orders.select("o_orderkey"), given.unionByName(extra), "o_orderkey", "prediction")


@query("select o_orderkey, o_totalprice * 2 as prediction from orders")
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("prediction"))
    turn = F.col("o_orderkey") % 3
    return concat_batches(
        [scored.where(turn == 0), scored.where(turn == 1).select("prediction", "o_orderkey"), scored.where(turn == 2)]
    )


@query(
    f"""select o_custkey from ({FOLDED_ORDERS}) where fold = 0 intersect
    select o_custkey from ({FOLDED_ORDERS}) where fold = 1"""
)
def shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = folded_orders(spark, sf_dir)
    first, second = (orders.where(F.col("fold") == f).select("o_custkey").distinct() for f in (0, 1))
    return first.intersect(second)


@query(
    f"""select o_custkey from ({FOLDED_ORDERS}) where fold = 0 except
    select o_custkey from ({FOLDED_ORDERS}) where fold = 1"""
)
def group_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = folded_orders(spark, sf_dir)
    first, second = (orders.where(F.col("fold") == f).select("o_custkey").distinct() for f in (0, 1))
    return first.subtract(second)


@query(
    f"""select feature, round(coalesce(sum(importance) filter (importance > 0), 0), 6) as total_importance,
        count(*) filter (importance <= 0) as non_positive_folds, round(avg(importance), 6) as mean_importance,
        round(stddev_pop(importance), 6) as std_importance from ({IMPORTANCES}) group by 1"""
)
def importance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = metrics.importance_rollup(importances(spark, sf_dir))
    return rolled.withColumns({c: F.round(c, 6) for c in rolled.columns if c not in ("feature", "non_positive_folds")})


@query(
    f"""select arg_min(p_brand, s) as params, round(min(s), 6) as score
    from (select p_brand, avg({sql_hash32('p_partkey', '7')} % 1000 + p_size) as s from part group by 1)"""
)
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    noise = hash32(F.col("p_partkey"), F.lit(7)) % 1000 + F.col("p_size")
    trials = part.groupBy(F.col("p_brand").alias("params")).agg(F.avg(noise).alias("score"))
    return metrics.best_by(trials, "score", "params", "score").withColumn("score", F.round("score", 6))
