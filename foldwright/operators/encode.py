"""Categories, one-hot columns, standard scores and the match feature plan.

Everything learned from training rows is kept as data, so other rows go through
the same columns and codes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.numeric import z_score
from foldwright.functions.text import agent_columns, char_count
from foldwright.operators.joins import attach_by_group
from foldwright.operators.profile import constant_columns, moments
from foldwright.operators.project import of_type
from foldwright.operators.rowindex import with_row_index
from foldwright.session import stored

# Level tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEVELS = 100_000
# A one-hot encoding names one column per level, so the levels become a schema.
MAX_ONE_HOT_LEVELS = 10_000

# Free-text and group columns of a match row that are no features.
FREE_TEXT = {"EnglishRules": "char_count_english", "LudRules": "char_count_lud"}
GROUP_COLUMN = "GameRulesetName"
AGENTS = {"agent1": "p1", "agent2": "p2"}


def category_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, rows, index): the levels of each column, numbered alphabetically from 0."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns]
    levels = (
        df.select(F.inline(F.array(*pairs)))
        .where("level is not null")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    indexed = with_row_index(levels, ["column", "level"], "_row")
    first = indexed.groupBy("column").agg(F.min("_row").alias("_first"))  # one row per column
    numbered = indexed.join(F.broadcast(first), "column")
    return stored(numbered.select("column", "level", "rows", (F.col("_row") - F.col("_first")).alias("index")))


def encode_categories(df: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its level's index; NULL and unseen levels get the number of levels."""
    counts = {r["column"]: r["count"] for r in levels.groupBy("column").count().collect()}
    out = df
    for column in columns:
        unseen = counts.get(column, 0)
        table = levels.where(F.col("column") == column).select(
            F.col("level").alias(column), "rows", F.col("index").alias("_index")
        )
        keyed = out.withColumn(column, F.col(f"`{column}`").cast("string"))
        if unseen <= BROADCAST_LEVELS:
            joined = keyed.join(F.broadcast(table.drop("rows")), column, "left")
        else:
            joined = attach_by_group(keyed, table, [column], "rows", how="left")
        code = F.coalesce(F.col("_index"), F.lit(unseen)).cast("int")
        out = joined.withColumn(column, code).select(*df.columns)
    return out


def one_hot(df: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by 0/1 columns `<column>_<level>`, appended; NULL and unseen are all 0.

    The levels become a schema, so there can only be so many; `one_hot_positions` has no limit.
    Names that would coincide, with one another or with a column that stays, are refused.
    """
    known = levels.where(F.col("column").isin(columns)).select("column", "level")
    rows = known.limit(MAX_ONE_HOT_LEVELS + 1).collect()
    if len(rows) > MAX_ONE_HOT_LEVELS:
        raise ValueError(f"more than {MAX_ONE_HOT_LEVELS} levels: use one_hot_positions")
    flags, taken = {}, {c.lower() for c in df.columns if c not in columns}
    for column in columns:
        for level in sorted(r["level"] for r in rows if r["column"] == column):
            same = F.col(f"`{column}`").cast("string").eqNullSafe(F.lit(level))
            name = f"{column}_{level}"
            if name.lower() in taken:
                raise ValueError(f"two one-hot columns would be named {name}: rename a column or use one_hot_positions")
            taken.add(name.lower())
            flags[name] = F.when(same, 1).otherwise(0)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, *[flag.alias(name) for name, flag in flags.items()])


def one_hot_names(levels: DataFrame, columns: list[str]) -> DataFrame:
    """(position, column, level): what each position of `one_hot_positions` stands for, any number of them."""
    known = levels.where(F.col("column").isin(columns))
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])[F.col("column")]
    starts = _starts(levels, columns)
    start = F.get(F.lit(starts).cast("array<bigint>"), place)
    return known.select((start + F.col("index")).alias("position"), "column", "level")


def _starts(levels: DataFrame, columns: list[str]) -> list[int]:
    counts = {r["column"]: r["count"] for r in levels.groupBy("column").count().collect()}  # one row per column
    return [sum(counts.get(c, 0) for c in columns[:i]) for i in range(len(columns) + 1)]


def one_hot_positions(df: DataFrame, levels: DataFrame, columns: list[str], name: str = "positions") -> DataFrame:
    """Replace the columns by `name`, the sorted positions that hold a 1 in the one-hot vector.

    The vector has one position per level of each column in turn, as `one_hot_names` lists them; NULL and
    unseen levels have none. There is no limit to the number of levels, and equal names do no harm.
    """
    starts = _starts(levels, columns)
    coded = encode_categories(df, levels, columns)
    places = [
        F.when(F.col(f"`{c}`") < starts[i + 1] - starts[i], F.col(f"`{c}`").cast("bigint") + starts[i])
        for i, c in enumerate(columns)
    ]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return coded.select(*kept, F.array_compact(F.array(*places)).alias(name))


@dataclass(frozen=True)
class Standardiser:
    """Means and deviations of training columns."""

    means: dict[str, float]
    stds: dict[str, float]
    eps: float = 1e-4

    def apply(self, df: DataFrame) -> DataFrame:
        """Standard scores in place of the fitted columns."""
        return df.withColumns(
            {
                c: z_score(F.col(c).cast("double"), F.lit(self.means[c]), F.lit(self.stds[c]), self.eps)
                for c in self.means
            }
        )


    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, self.means[c], self.stds[c], self.eps) for c in self.means]
        spark.createDataFrame(rows, "column string, mean double, std double, eps double").write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Standardiser:
        rows = spark.read.parquet(path).collect()  # one per column
        return Standardiser({r["column"]: r["mean"] for r in rows}, {r["column"]: r["std"] for r in rows}, rows[0]["eps"])


def fit_standardiser(train: DataFrame, columns: list[str], eps: float = 1e-4) -> Standardiser:
    """Learn from training rows only; one small row per column reaches the driver."""
    rows = {r["column"]: r for r in moments(train, columns).collect()}
    return Standardiser({c: rows[c]["mean"] for c in columns}, {c: rows[c]["std"] for c in columns}, eps)


@dataclass(frozen=True)
class FeaturePlan:
    """What was learned from training matches."""

    dropped: list[str]
    coded: list[str]
    levels: DataFrame

    def save(self, path: str) -> None:
        """Write the plan under `path`, for jobs that score later."""
        self.levels.write.parquet(f"{path}/levels")
        names = [("dropped", self.dropped), ("coded", self.coded)]
        self.levels.sparkSession.createDataFrame(names, "part string, names array<string>").write.parquet(f"{path}/names")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeaturePlan:
        names = {r["part"]: r["names"] for r in spark.read.parquet(f"{path}/names").collect()}
        return FeaturePlan(names["dropped"], names["coded"], spark.read.parquet(f"{path}/levels"))


def derive_features(df: DataFrame) -> DataFrame:
    """Text lengths and agent parts in, free text and group out."""
    lengths = {new: char_count(F.col(text)) for text, new in FREE_TEXT.items() if text in df.columns}
    parts = {}
    for agent, prefix in AGENTS.items():
        if agent in df.columns:
            parts.update(agent_columns(F.col(agent), prefix))
    return df.withColumns({**lengths, **parts}).drop(GROUP_COLUMN, *FREE_TEXT)


def fit_features(train: DataFrame) -> FeaturePlan:
    """Constant columns and category levels of the training matches."""
    dropped = constant_columns(train)
    derived = derive_features(train.drop(*dropped))
    coded = of_type(derived, T.StringType)
    return FeaturePlan(dropped, coded, category_levels(derived, coded))


def transform_features(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """The feature columns of any matches, with the codes learned in training."""
    derived = derive_features(df.drop(*plan.dropped))
    return encode_categories(derived, plan.levels, [c for c in plan.coded if c in derived.columns])
