"""The tables queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.numeric import hash_fold

SEED = 7
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash32(*parts: str) -> str:
    """SQL of `hash32`."""
    texts = ", ".join(f"({p})::varchar" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {texts})), 1, 8))::bigint"


def sql_fold(key: str, folds: int = FOLDS, seed: int = SEED) -> str:
    """SQL of `hash_fold`."""
    return f"({sql_hash32(key, str(seed))} % {folds})::int"


def folded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a fold by key and a holdout of about a tenth."""
    orders = table(spark, sf_dir, "orders")
    return orders.withColumn("fold", hash_fold(F.col("o_orderkey"), FOLDS, SEED)).withColumn(
        "holdout", hash_fold(F.col("o_orderkey"), 10, SEED + 1) == 0
    )


FOLDED_ORDERS = f"""
    select *, {sql_fold('o_orderkey')} as fold, {sql_fold('o_orderkey', 10, SEED + 1)} = 0 as holdout from orders
"""


def agent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, agent): agent names made of part attributes.

    Every 11th has a dash more, every 13th no prefix, every 17th no number, every 19th is NULL.
    """
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    number = F.format_string("%.1f", F.col("p_size") / 10)
    key = F.col("p_partkey")
    agent = F.concat_ws(
        "-",
        F.when(key % 13 == 0, "UCT").otherwise("MCTS"),
        F.when(key % 11 == 0, F.concat("p_type", F.lit("-X"))).otherwise(F.col("p_type")),
        F.when(key % 17 == 0, "none").otherwise(number),
        F.get(words, F.lit(0)),
        F.get(words, F.lit(1)),
    )
    return part.select("p_partkey", F.when(key % 19 != 0, agent).alias("agent"))


AGENT_NAMES = """
    select p_partkey, case when p_partkey % 19 <> 0 then concat_ws('-',
        case when p_partkey % 13 = 0 then 'UCT' else 'MCTS' end,
        case when p_partkey % 11 = 0 then p_type || '-X' else p_type end,
        case when p_partkey % 17 = 0 then 'none' else printf('%.1f', p_size / 10.0::double) end,
        split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) end as agent
    from part
"""


def sql_agent_part(agent: str, group: int) -> str:
    pattern = "'MCTS-(.*)-(.*)-(.*)-(.*)'"
    text = f"case when regexp_matches({agent}, {pattern}) then regexp_extract({agent}, {pattern}, {group}) end"
    return f"try_cast({text} as float)" if group == 2 else text


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rows: a part's agent against the next part's, with text, constant and empty columns."""
    agents = agent_names(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    rows = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    second = agents.select((F.pmod(F.col("p_partkey") - 1, rows)).alias("p_partkey"), F.col("agent").alias("agent2"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("EnglishRules"))
    joined = part.join(agents, "p_partkey").join(second, "p_partkey").join(texts, "p_partkey", "left")
    return joined.select(
        F.col("p_partkey").alias("Id"),
        F.col("p_brand").alias("GameRulesetName"),
        F.col("agent").alias("agent1"),
        "agent2",
        F.col("p_size").alias("NumRows"),
        F.lit(2).alias("NumPlayers"),
        F.lit(None).cast("string").alias("Behaviour"),
        "EnglishRules",
        F.col("p_name").alias("LudRules"),
        F.col("p_retailprice").alias("utility_agent1"),
    )


MATCHES = f"""
    select p.p_partkey as Id, p.p_brand as GameRulesetName, a.agent as agent1, b.agent as agent2,
        p.p_size as NumRows, d.text as EnglishRules, p.p_name as LudRules, p.p_retailprice as utility_agent1
    from part p join ({AGENT_NAMES}) a using (p_partkey)
    join ({AGENT_NAMES}) b on b.p_partkey = (p.p_partkey + 1) % (select count(*) from part)
    left join documents d on d.doc_id = p.p_partkey
"""


EVENT_TYPES = ["click", "view", "signup", "purchase", "error"]


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, num_click, ...): events of each kind per user and day; 0 views are NULL."""
    events = table(spark, sf_dir, "events")
    counts = [F.count_if(F.col("event_type") == t).alias(f"num_{t}") for t in EVENT_TYPES]
    grouped = events.groupBy("user_id", F.dayofyear("ts").alias("day")).agg(*counts)
    return grouped.withColumn("num_view", F.nullif("num_view", F.lit(0)))


EVENT_COUNTS = (
    "select user_id, dayofyear(ts)::int as day, "
    + ", ".join(
        f"nullif(count(*) filter (event_type = '{t}'), 0) as num_{t}"
        if t == "view"
        else f"count(*) filter (event_type = '{t}') as num_{t}"
        for t in EVENT_TYPES
    )
    + " from events group by 1, 2"
)


MEASURES = ["avg_quantity", "avg_discount", "avg_tax", "n_lines", "n_returned"]
# A fixed linear prediction of the total price: tax and returns do not count.
WEIGHTS = [4000.0, -2000.0, 0.0, 50000.0, 0.0]
INTERCEPT = -100000.0
TARGET = "total_price"


def order_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: measures, total price, fold and holdout."""
    lines = table(spark, sf_dir, "lineitem")
    grouped = lines.groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("avg_quantity"),
        F.avg("l_discount").alias("avg_discount"),
        F.avg("l_tax").alias("avg_tax"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("n_returned"),
        F.sum("l_extendedprice").alias(TARGET),
    )
    return grouped.withColumn("fold", hash_fold(F.col("l_orderkey"), FOLDS, SEED)).withColumn(
        "holdout", hash_fold(F.col("l_orderkey"), 10, SEED + 1) == 0
    )


ORDER_MEASURES = f"""
    select l_orderkey, avg(l_quantity) as avg_quantity, avg(l_discount) as avg_discount, avg(l_tax) as avg_tax,
        count(*)::double as n_lines, (count(*) filter (l_returnflag = 'R'))::double as n_returned,
        sum(l_extendedprice) as total_price, {sql_fold('l_orderkey')} as fold,
        {sql_fold('l_orderkey', 10, SEED + 1)} = 0 as holdout
    from lineitem group by l_orderkey
"""


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, fold, importance): one value per brand and fold, of either sign."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("feature"), (F.col("p_partkey") % FOLDS).cast("int").alias("fold")).agg(
        ((F.avg("p_size") - 25.5) / 100).alias("importance")
    )


IMPORTANCES = f"""
    select p_brand as feature, (p_partkey % {FOLDS})::int as fold, (avg(p_size) - 25.5) / 100 as importance
    from part group by 1, 2
"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as (query_id, vector) and as (support_id, vector, label)."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    support = rows.select(
        F.col("vec_id").alias("support_id"), F.col("embedding").alias("vector"), F.col("label").cast("double").alias("label")
    )
    return queries, support
