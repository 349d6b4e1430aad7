"""The three paired tensors that the registered queries derive from the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.align import signals
from pairlens.schema import PairedTensor, coord_names
from pairlens.sources.facts import pair_from_facts

ORDER4_DIMS = (25, 25, 6, 5)
EVENT3_DIMS = (16, 5, 24)
RANK = 4
SEED = 1
#: Order lines that one task joins with their orders, or merges into cells.
LINES_PER_TASK = 1 << 18

# Category -> index, as stated with the fixtures.
PART_TYPES = ("ECONOMY", "SMALL", "STANDARD", "PROMO", "MEDIUM")      # anything else: 5
EVENT_TYPES = ("click", "error", "purchase", "signup")                # anything else: 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(column: str, values: tuple[str, ...]):
    out = F.when(F.col(column) == values[0], 0)
    for i, v in enumerate(values[1:], start=1):
        out = out.when(F.col(column) == v, i)
    return out.otherwise(len(values))


def _returned_or_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))


def order4_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = (
        _returned_or_accepted(spark, sf_dir)
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return pair_from_facts(
        facts,
        [
            F.col("c_nationkey"),
            F.substring("p_brand", 7, 10).cast("int") - 1,
            _code("p_type", PART_TYPES),
            F.substring("o_orderpriority", 1, 1).cast("int") - 1,
        ],
        is_x=F.col("l_returnflag") == "R",
        is_y=F.col("l_returnflag") == "A",
        value=F.col("l_quantity"),
    )


def event3_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.lit("2024-01-16").cast("timestamp_ntz")
    return pair_from_facts(
        table(spark, sf_dir, "events"),
        [
            F.pmod(F.col("user_id"), F.lit(16)),
            _code("event_type", EVENT_TYPES),
            F.hour("ts"),
        ],
        is_x=F.col("ts") < split,
        is_y=F.col("ts") >= split,
        value=F.lit(1.0),
    )


def line3_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are nearly as many as order lines, so tasks are counted by lines: none grows with the tables."""
    lines = table(spark, sf_dir, "lineitem").count()  # from file footers
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(lines / LINES_PER_TASK))
    facts = _returned_or_accepted(spark, sf_dir).repartition(parts, "l_orderkey").join(
        table(spark, sf_dir, "orders").repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return pair_from_facts(
        facts,
        [F.col("o_custkey"), F.col("l_partkey"), F.col("l_suppkey")],
        is_x=F.col("l_returnflag") == "R",
        is_y=F.col("l_returnflag") == "A",
        value=F.col("l_quantity"),
        parts=parts,
    )


def order4(spark: SparkSession, sf_dir: str) -> PairedTensor:
    return PairedTensor(signals(order4_pair(spark, sf_dir), coord_names(4)), ORDER4_DIMS)


def event3(spark: SparkSession, sf_dir: str) -> PairedTensor:
    return PairedTensor(signals(event3_pair(spark, sf_dir), coord_names(3)), EVENT3_DIMS)


def line3(spark: SparkSession, sf_dir: str) -> PairedTensor:
    """Dimensions are table sizes; parquet counts come from file footers."""
    sizes = tuple(table(spark, sf_dir, n).count() for n in ("customer", "part", "supplier"))
    return PairedTensor(signals(line3_pair(spark, sf_dir), coord_names(3)), sizes)
