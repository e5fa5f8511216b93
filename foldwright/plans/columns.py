"""Projections, filters and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions import text as tx
from foldwright.functions.numeric import rounded_even
from foldwright.operators import metrics, profile, project, splits
from foldwright.operators.rowindex import split_by_order
from foldwright.plans.inputs import (
    AGENT_NAMES,
    EVENT_COUNTS,
    FOLDED_ORDERS,
    IMPORTANCES,
    agent_names,
    event_counts,
    folded_orders,
    importances,
    sql_agent_part,
    table,
)
from foldwright.plans.registry import query

# An exclusion list put together from rounds, with a repeat.
AVOID = ["l_tax", "l_discount"] + ["l_linestatus", "l_tax"]
IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").drop("o_custkey", "o_orderstatus", "o_orderdate")


@query("select o_totalprice, o_orderkey from orders")
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.select_names(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"])


@query(f"select num_click, num_view, num_signup, num_purchase, num_error from ({EVENT_COUNTS})")
def select_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = event_counts(spark, sf_dir)
    return counts.select(counts.colRegex("`^num_.*$`"))


@query("select l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def select_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return project.select_names(lines, project.of_type(lines, T.DoubleType))


@query("select l_linenumber, l_quantity, l_extendedprice, l_returnflag from lineitem")
def exclude_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return project.select_names(lines, project.excluding(lines, IDS, AVOID))


@query(
    """select doc_id, source as origin, length(text) as char_count, length(text) = n_chars as same from documents"""
)
def derive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("char_count", tx.char_count(F.col("text")).cast("bigint"))
    renamed = documents.withColumnRenamed("source", "origin")
    return renamed.withColumn("same", F.col("char_count") == F.col("n_chars")).select(
        "doc_id", "origin", "char_count", "same"
    )


@query("select doc_id, length(text) as chars, length(nullif(lang, 'en')) as lang_chars from documents")
def char_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.char_count(F.col("text")).cast("bigint").alias("chars"),
        tx.char_count(F.nullif("lang", F.lit("en"))).cast("bigint").alias("lang_chars"),
    )


@query(f"select user_id, day, num_signup + num_purchase = 0 as always_draw from ({EVENT_COUNTS})")
def always_draw_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("num_signup") + F.col("num_purchase") == 0
    return event_counts(spark, sf_dir).select("user_id", "day", flag.alias("always_draw"))


@query(f"select count(*) filter (num_signup + num_purchase = 0) as always_draw from ({EVENT_COUNTS})")
def always_draw_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(spark, sf_dir).agg(
        F.count_if(F.col("num_signup") + F.col("num_purchase") == 0).alias("always_draw")
    )


@query(
    """select o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey
    where c_mktsegment = 'MACHINERY'"""
)
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    machinery = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    orders = table(spark, sf_dir, "orders")
    return orders.join(machinery, orders.o_custkey == machinery.c_custkey, "left_semi").select(
        "o_orderkey", "o_totalprice"
    )


@query(f"select o_orderkey from ({FOLDED_ORDERS}) where fold <> 0 and not holdout")
def train_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.training_rows(folded_orders(spark, sf_dir), 0).select("o_orderkey")


@query(
    f"""select feature, count(*) filter (importance > 0) as positive, count(*) filter (importance <= 0) as useless,
        count(*) filter (importance < -0.001) as negative from ({IMPORTANCES}) group by 1
    having count(*) filter (importance <= 0) >= 2"""
)
def importance_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("importance")
    counts = importances(spark, sf_dir).groupBy("feature").agg(
        F.count_if(value > 0).alias("positive"),
        F.count_if(value <= 0).alias("useless"),
        F.count_if(value < -0.001).alias("negative"),
    )
    return counts.where(F.col("useless") >= 2)


@query(
    """with u as (
        select 'l_linenumber' as "column", count(distinct l_linenumber) as n_unique from lineitem
        union all select 'l_orderkey', count(distinct l_orderkey) from lineitem
        union all select 'l_partkey', count(distinct l_partkey) from lineitem
        union all select 'l_suppkey', count(distinct l_suppkey) from lineitem
        union all select 'l_quantity', count(distinct l_quantity) from lineitem
        union all select 'l_extendedprice', count(distinct l_extendedprice) from lineitem
        union all select 'l_discount', count(distinct l_discount) from lineitem
        union all select 'l_tax', count(distinct l_tax) from lineitem
        union all select 'l_returnflag', count(distinct l_returnflag) from lineitem
        union all select 'l_linestatus', count(distinct l_linestatus) from lineitem
        union all select 'l_shipdate', count(distinct l_shipdate) from lineitem)
    select * from u where n_unique < 200"""
)
def low_cardinality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.low_cardinality_columns(table(spark, sf_dir, "lineitem"), 200)


@query(
    """with o as (select *, row_number() over (order by o_totalprice, o_orderkey) as r, count(*) over () as n from orders)
    select case when r <= floor(n * 0.8::double) then 'head' else 'tail' end as split, count(*) as n,
        min(o_totalprice) as low, max(o_totalprice) as high from o group by 1"""
)
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return split_by_order(orders, ["o_totalprice", "o_orderkey"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )


AGENT_PARTS_SQL = f"""select p_partkey, {sql_agent_part('agent', 1)} as p1_selection,
    ({sql_agent_part('agent', 2)})::double as p1_exploration, {sql_agent_part('agent', 3)} as p1_playout,
    {sql_agent_part('agent', 4)} as p1_bounds from ({AGENT_NAMES})"""


@query(AGENT_PARTS_SQL)
def parse_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = agent_names(spark, sf_dir).withColumns(tx.agent_columns(F.col("agent"), "p1")).drop("agent")
    return parsed.withColumn("p1_exploration", F.col("p1_exploration").cast("double"))


@query(
    f"""with a as ({AGENT_PARTS_SQL}), n as (select count(*) as n from part)
    select a.p_partkey, round(a.p1_exploration - b.p1_exploration, 4) as exploration_diff,
        a.p1_selection || '-' || b.p1_selection as selection_pair, a.p1_playout || '-' || b.p1_playout as playout_pair,
        a.p1_bounds || '-' || b.p1_bounds as bounds_pair
    from a, n, a b where b.p_partkey = (a.p_partkey + 1) % n.n"""
)
def agent_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = agent_names(spark, sf_dir)
    rows = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    first = agents.withColumns(tx.agent_columns(F.col("agent"), "p1")).drop("agent")
    second = agents.withColumns(tx.agent_columns(F.col("agent"), "p2")).drop("agent")
    second = second.withColumn("p_partkey", F.pmod(F.col("p_partkey") - 1, rows))
    pairs = first.join(second, "p_partkey").select("p_partkey", *[c.alias(n) for n, c in tx.pair_columns().items()])
    return pairs.withColumn("exploration_diff", F.round(F.col("exploration_diff").cast("double"), 4))


@query(
    """select l_returnflag, round_even(avg(l_quantity), 3) as mean_quantity, round_even(avg(l_tax), 3) as mean_tax
    from lineitem group by 1"""
)
def rounded_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        rounded_even(F.avg("l_quantity")).alias("mean_quantity"), rounded_even(F.avg("l_tax")).alias("mean_tax")
    )


@query(f"select feature, round(sum(importance), 6) as total from ({IMPORTANCES}) group by 1")
def ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = importances(spark, sf_dir).groupBy("feature").agg(F.round(F.sum("importance"), 6).alias("total"))
    return metrics.ranked(totals, "total", "feature")
