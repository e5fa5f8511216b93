"""Column profiles and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators import profile
from foldwright.plans.inputs import EVENT_COUNTS, MATCHES, agent_names, AGENT_NAMES, event_counts, matches, table
from foldwright.plans.registry import query


def _union(columns: list[str], expression: str, source: str, name: str) -> str:
    """One SELECT per column, with {c} for the column in the expression."""
    parts = [f"""select '{c}' as "column", {expression.format(c=c)} as {name} from {source}""" for c in columns]
    return " union all ".join(parts)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "nothing", "same", "gaps"]
# Orders with an empty, a constant and a constant-or-NULL column.
ORDERS_WITH_GAPS = """(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    null::varchar as nothing, 1 as same, case when o_orderkey % 2 = 0 then 1 end as gaps from orders)"""
UNIQUE = "count(distinct {c}) + max(case when {c} is null then 1 else 0 end)"


def _orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        *ORDER_COLUMNS[:5],
        F.lit(None).cast("string").alias("nothing"),
        F.lit(1).alias("same"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).alias("gaps"),
    )


@query(_union(ORDER_COLUMNS, UNIQUE, ORDERS_WITH_GAPS, "n_unique"))
def column_n_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.n_unique(_orders_with_gaps(spark, sf_dir))


@query(f"""select "column" from ({_union(ORDER_COLUMNS, UNIQUE, ORDERS_WITH_GAPS, 'n')}) where n = 1""")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.constant_flags(_orders_with_gaps(spark, sf_dir)).where("is_constant").select("column")


@query(
    f"""select "column" from ({_union(ORDER_COLUMNS, UNIQUE, ORDERS_WITH_GAPS, 'n')})
    where n = (select count(*) from orders)"""
)
def id_like_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.id_like_columns(_orders_with_gaps(spark, sf_dir))


@query(
    f"""select count(*) filter (n = 2) as binary_columns from ({_union(ORDER_COLUMNS, UNIQUE, ORDERS_WITH_GAPS, 'n')})"""
)
def binary_column_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.binary_column_count(_orders_with_gaps(spark, sf_dir))


MATCH_COLUMNS = ["Id", "GameRulesetName", "agent1", "agent2", "NumRows", "EnglishRules", "LudRules", "utility_agent1"]


@query(_union(MATCH_COLUMNS, "count(*) - count({c})", f"({MATCHES})", "nulls"))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(matches(spark, sf_dir).drop("NumPlayers", "Behaviour"))


@query(
    """select count(*) - (select count(*) from (select distinct l_returnflag, l_linestatus, l_quantity, l_tax from lineitem))
        as duplicates from lineitem"""
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return profile.duplicate_rows(lines.select("l_returnflag", "l_linestatus", "l_quantity", "l_tax"))


@query(f"select agent, count(*) as count from ({AGENT_NAMES}) group by 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(agent_names(spark, sf_dir), "agent")


@query(
    f"""select (num_click + coalesce(num_view, 0) + num_signup + num_purchase + num_error)::bigint as num_events,
        count(*) as count from ({EVENT_COUNTS}) group by 1"""
)
def row_sum_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_sum_histogram(event_counts(spark, sf_dir), r"^num_.*$", "num_events")


@query(
    """select round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std,
        min(o_totalprice) as min, max(o_totalprice) as max from orders"""
)
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = profile.summary(table(spark, sf_dir, "orders"), "o_totalprice")
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " union all ".join(
        f"""select '{c}' as feature, round(max(s), 6) as max_std from
            (select stddev_samp({c}) as s from lineitem group by l_returnflag)"""
        for c in LINE_NUMBERS
    )
)
def within_group_max_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", *LINE_NUMBERS)
    return profile.within_group_max_std(lines, "l_returnflag").withColumn("max_std", F.round("max_std", 6))


@query("select count(*) as n_groups from (select distinct o_custkey from orders)")
def distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_count(table(spark, sf_dir, "orders"), "o_custkey", "n_groups")


@query(
    _union(LINE_NUMBERS, "round(avg({c}), 6) as mean, round(stddev_samp({c}), 6)", "lineitem", "std")
)
def column_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.moments(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))
