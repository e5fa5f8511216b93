"""Folds, encodings and fold scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.numeric import z_score
from foldwright.operators import encode, metrics, profile, splits
from foldwright.operators.joins import attach_by_group
from foldwright.plans.inputs import FOLDED_ORDERS, FOLDS, MATCHES, folded_orders, matches, sql_agent_part, table
from foldwright.plans.registry import query
from foldwright.session import scratch_path, stored

BALANCED = f"""with recursive g as (
    select o_custkey, count(*) as n, row_number() over (order by count(*) desc, o_custkey) as rn from orders group by 1),
r as (
    select 0::bigint as rn, 0::bigint as o_custkey, 0::bigint as n, -1 as fold,
        list_transform(range({FOLDS}), lambda x: 0::bigint) as loads
    union all
    select g.rn, g.o_custkey, g.n, (list_position(loads, list_min(loads)) - 1)::int,
        list_transform(loads, lambda v, i: if(i = list_position(loads, list_min(loads)), v + g.n, v))
    from r join g on g.rn = r.rn + 1)
select o_custkey, n, fold from r where rn > 0"""


@query(BALANCED)
def balanced_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balanced_group_folds(table(spark, sf_dir, "orders"), "o_custkey", FOLDS)


# Cents above or below the middle: whole numbers, so sums are exact in any order.
CENTRED = "cast(round(o_totalprice * 100) as bigint) - 25000000"


@query(
    f"""with recursive items as (select o_custkey, count(*) as n, sum({CENTRED})::bigint as total from orders group by 1),
k as (select *, row_number() over (partition by n order by total, o_custkey) - 1 as rank, count(*) over (partition by n) as groups from items),
p as (select *, case when rank // {FOLDS} % 2 = 0 then rank
    else rank // {FOLDS} * {FOLDS} + least({FOLDS}, groups - rank // {FOLDS} * {FOLDS}) - 1 - rank % {FOLDS} end as place from k),
g as (select *, row_number() over (order by n desc, place) as rn from p),
r as (
    select 0::bigint as rn, 0::bigint as o_custkey, -1 as fold, list_transform(range({FOLDS}), lambda x: 0::bigint) as loads
    union all
    select g.rn, g.o_custkey, (list_position(loads, list_min(loads)) - 1)::int,
        list_transform(loads, lambda v, i: if(i = list_position(loads, list_min(loads)), v + g.n, v))
    from r join g on g.rn = r.rn + 1)
select o_custkey, fold from r where rn > 0"""
)
def target_balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("centred", F.expr(CENTRED))
    return splits.target_balanced_folds(orders, "o_custkey", "centred", FOLDS).select("o_custkey", "fold")


@query(
    f"""select fold, count(*) as size, round(avg({CENTRED}), 6) as mean_centred
    from orders join ({BALANCED}) using (o_custkey) group by 1"""
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.expr(CENTRED).alias("centred"))
    folds = splits.balanced_group_folds(orders, "o_custkey", FOLDS)
    found = splits.fold_summary(splits.attach_folds(orders, folds, "o_custkey"), "fold", ["centred"])
    return found.withColumn("mean_centred", F.round("mean_centred", 6))


@query(
    f"""select o_custkey, count(distinct fold) as n_folds, string_agg(distinct fold::varchar, ',' order by fold::varchar) as folds
    from ({FOLDED_ORDERS}) group by 1 having count(distinct fold) > 1"""
)
def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaking_groups(folded_orders(spark, sf_dir), "o_custkey", "fold")


OUT_OF_FOLD = f"""
    select f.o_orderkey, f.fold, f.o_totalprice, coalesce(m.mean, w.mean) as prediction
    from (select * from ({FOLDED_ORDERS}) where not holdout) f
    left join (select k.fold, o.o_orderpriority, avg(o.o_totalprice) as mean from (select unnest(range({FOLDS})) as fold) k
        join ({FOLDED_ORDERS}) o on o.fold <> k.fold and not o.holdout group by 1, 2) m
        on m.fold = f.fold and m.o_orderpriority = f.o_orderpriority
    left join (select k.fold, avg(o.o_totalprice) as mean from (select unnest(range({FOLDS})) as fold) k
        join ({FOLDED_ORDERS}) o on o.fold <> k.fold and not o.holdout group by 1) w on w.fold = f.fold
"""


def _out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = folded_orders(spark, sf_dir).where(~F.col("holdout"))
    return metrics.out_of_fold_means(orders, "fold", "o_orderpriority", "o_totalprice")


@query(f"select o_orderkey, fold, round(prediction, 4) as prediction from ({OUT_OF_FOLD})")
def cv_category_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out_of_fold(spark, sf_dir).select("o_orderkey", "fold", F.round("prediction", 4).alias("prediction"))


@query(
    f"""with t as (select * from ({FOLDED_ORDERS})),
    m as (select k.fold, o.o_orderpriority, avg(o.o_totalprice) as mean from (select unnest(range({FOLDS})) as fold) k
        join t o on o.fold <> k.fold and not o.holdout group by 1, 2)
    select o_orderkey, round(avg(mean), 4) as prediction from t join m using (o_orderpriority) where holdout group by 1"""
)
def fold_models_on_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout predicted by every fold's model, and their mean."""
    orders = folded_orders(spark, sf_dir)
    kept, held = orders.where(~F.col("holdout")), orders.where("holdout")
    found = metrics.mean_of_fold_models(kept, held, "fold", "o_orderpriority", "o_totalprice")
    return found.select("o_orderkey", F.round("prediction", 4).alias("prediction"))


@query(f"select fold, round(sqrt(avg((o_totalprice - prediction) ** 2)), 4) as rmse from ({OUT_OF_FOLD}) group by 1")
def rmse_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.rmse_by(_out_of_fold(spark, sf_dir), "o_totalprice", "prediction", "fold")
    return scores.withColumn("rmse", F.round("rmse", 4))


@query(
    f"""select round(avg(rmse), 4) as mean_rmse, round(stddev_pop(rmse), 4) as std_rmse from (
        select fold, sqrt(avg((o_totalprice - prediction) ** 2)) as rmse from ({OUT_OF_FOLD}) group by 1)"""
)
def cv_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.rmse_by(_out_of_fold(spark, sf_dir), "o_totalprice", "prediction", "fold")
    return metrics.score_summary(scores).select(
        F.round("mean_rmse", 4).alias("mean_rmse"), F.round("std_rmse", 4).alias("std_rmse")
    )


@query(
    """select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::int as o_orderpriority,
        (dense_rank() over (order by o_orderstatus) - 1)::int as o_orderstatus from orders"""
)
def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    coded = ["o_orderpriority", "o_orderstatus"]
    return encode.encode_categories(orders, encode.category_levels(orders, coded), coded)


@query(
    """select o_orderkey, if(o_orderstatus = 'F', 1, 0) as "o_orderstatus_F", if(o_orderstatus = 'O', 1, 0) as "o_orderstatus_O",
        if(o_orderstatus = 'P' and o_orderkey % 7 <> 0, 1, 0) as "o_orderstatus_P" from orders"""
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 7 != 0), F.col("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("o_orderstatus"))
    return encode.one_hot(orders, encode.category_levels(orders, ["o_orderstatus"]), ["o_orderstatus"])


@query(
    """select l_orderkey, round((l_quantity - avg(l_quantity) over ()) / (stddev_samp(l_quantity) over () + 1e-4), 6) as quantity,
        round((l_tax - avg(l_tax) over ()) / (stddev_samp(l_tax) over () + 1e-4), 6) as tax from lineitem"""
)
def standardise_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    stats = profile.moments(lines, ["l_quantity", "l_tax"])
    entries = F.collect_list(F.struct("column", F.struct("mean", "std")))  # one per column
    by_column = stats.agg(F.map_from_entries(entries)).scalar()

    def scored(column: str):
        own = by_column[column]
        return F.round(z_score(F.col(column), own["mean"], own["std"]), 6)

    return lines.select("l_orderkey", scored("l_quantity").alias("quantity"), scored("l_tax").alias("tax"))


@query(
    f"""select o_orderkey, fold, round((o_totalprice - m) / (s + 1e-4), 6) as o_totalprice
    from ({FOLDED_ORDERS}), (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from ({FOLDED_ORDERS})
        where fold <> 0 and not holdout)"""
)
def standardise_fit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = folded_orders(spark, sf_dir)
    fitted = encode.fit_standardiser(splits.training_rows(orders, 0), ["o_totalprice"])
    return fitted.apply(orders).select("o_orderkey", "fold", F.round("o_totalprice", 6).alias("o_totalprice"))


def _sql_code(text: str) -> str:
    """Rank of a text among the distinct non-NULL texts of the frame; their number for NULL."""
    return (
        f"(case when {text} is null then (select count(distinct {text}) from t) "
        f"else dense_rank() over (order by {text} nulls last) - 1 end)::int"
    )


_PARTS = ["selection", "playout", "bounds"]
_PART_GROUP = {"selection": 1, "exploration": 2, "playout": 3, "bounds": 4}


@query(
    f"""with t as (select *, {', '.join(f"{sql_agent_part(f'agent{i}', g)} as p{i}_{p}"
        for i in (1, 2) for p, g in _PART_GROUP.items())} from ({MATCHES}))
    select Id as "Id", NumRows as "NumRows", utility_agent1, length(EnglishRules)::int as char_count_english,
        length(LudRules)::int as char_count_lud, p1_exploration::double as p1_exploration,
        p2_exploration::double as p2_exploration, {_sql_code('agent1')} as agent1, {_sql_code('agent2')} as agent2,
        {', '.join(f"{_sql_code(f'p{i}_{p}')} as p{i}_{p}" for i in (1, 2) for p in _PARTS)}
    from t"""
)
def preprocess_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(matches(spark, sf_dir))
    features = encode.transform_features(rows, encode.fit_features(rows))
    return features.withColumns({f"p{i}_exploration": F.col(f"p{i}_exploration").cast("double") for i in (1, 2)})


@query(
    """select o_orderkey, round((m.mean + s.mean + p.mean) / 3, 4) as prediction from orders
    join (select o_orderpriority, avg(o_totalprice) as mean, count(*) as n from orders group by 1) m using (o_orderpriority)
    join (select o_orderstatus, avg(o_totalprice) as mean, count(*) as n from orders group by 1) s using (o_orderstatus)
    join (select o_custkey, avg(o_totalprice) as mean, count(*) as n from orders group by 1) p using (o_custkey)"""
)
def ensemble_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldwright.operators.models import average_of

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", "o_totalprice")
    keys = ["o_orderpriority", "o_orderstatus", "o_custkey"]
    out = rows
    for key in keys:
        means = rows.groupBy(key).agg(F.avg("o_totalprice").alias(f"by_{key}"), F.count(F.lit(1)).alias("n"))
        out = attach_by_group(out, means, [key], "n")
    return out.select("o_orderkey", F.round(average_of([f"by_{k}" for k in keys]), 4).alias("prediction"))


_CODED = ["o_orderpriority", "o_custkey"]
_SQL_CODES = ", ".join(
    f"""{c}_l as (select {c}, row_number() over (order by {c}) - 1 as i from (
        select distinct {c}::varchar as {c} from t where fold <> 0 and not holdout and {c} is not null))"""
    for c in _CODED
)


@query(
    f"""with t as (select * from ({FOLDED_ORDERS})), {_SQL_CODES},
    s as (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as d from t where fold <> 0 and not holdout)
    select o_orderkey, coalesce(p.i, (select count(*) from o_orderpriority_l))::int as o_orderpriority,
        coalesce(c.i, (select count(*) from o_custkey_l))::int as o_custkey, round((o_totalprice - m) / (d + 1e-4), 6) as o_totalprice
    from t left join o_orderpriority_l p using (o_orderpriority) left join o_custkey_l c on c.o_custkey = t.o_custkey::varchar, s where fold = 0"""
)
def saved_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and scores of unseen rows, by a plan that was fitted, saved and loaded."""
    orders = folded_orders(spark, sf_dir)
    train = splits.training_rows(orders, 0)
    root = scratch_path(spark, "plan")
    encode.FeaturePlan([], _CODED, encode.category_levels(train, _CODED)).save(f"{root}/features")
    encode.fit_standardiser(train, ["o_totalprice"]).save(spark, f"{root}/scores")
    plan, scores = encode.FeaturePlan.load(spark, f"{root}/features"), encode.Standardiser.load(spark, f"{root}/scores")
    coded = encode.encode_categories(orders.where("fold = 0"), plan.levels, plan.coded)
    return scores.apply(coded).select("o_orderkey", *_CODED, F.round("o_totalprice", 6).alias("o_totalprice"))


@query(
    """with l as (
        select 0 as place, o_orderpriority as level, row_number() over (order by o_orderpriority) - 1 as i
            from (select distinct o_orderpriority from orders)
        union all select 1, c, row_number() over (order by c) - 1 from (select distinct o_custkey::varchar as c from orders)),
    n as (select count(*) as first from l where place = 0)
    select o_orderkey, p.i::bigint as first_position, (n.first + c.i)::bigint as second_position
    from orders join l p on p.place = 0 and p.level = o_orderpriority join l c on c.place = 1 and c.level = o_custkey::varchar, n"""
)
def one_hot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the ones of a one-hot vector over any number of levels."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *_CODED)
    found = encode.one_hot_positions(orders, encode.category_levels(orders, _CODED), _CODED)
    return found.select("o_orderkey", *[F.get("positions", F.lit(i)).alias(n) for i, n in enumerate(["first_position", "second_position"])])
