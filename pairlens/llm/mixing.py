"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Every source gets its weight's share of the budget, but at most ``max_epochs`` times its own size;
what a clamped source cannot take is shared among the rest by weight, until no source is above its
cap. In closed form: sort the sources by cap over weight; a source is clamped while its share of
what is left is at least its cap. A document is then taken ``floor(target / size)`` times, and once
more if its seeded hash is among the smallest of its source, up to the fractional rest.

The threshold of that hash is searched by sums of sizes, 12 bits of the hash at a time and for all
sources at once, so a source is never ordered in one task, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import stored, table, word_count

#: Contract values: weights by rank of the source, share of all sizes, largest number of epochs.
WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
#: Bits of the sampling hash and bits looked at per step.
HASH_BITS, STEP_BITS = 60, 12


def sampling_hash(doc_id: Column, seed: int) -> Column:
    """60 bits of md5 over the id and the seed; the same in any SQL engine."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(
    sources: DataFrame, weights: Sequence[float] | None, share: float, epochs: float
) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row per source, so windows here are small.

    Weights go to the sources in code-point order with null last, repeating. Sources of size 0 get 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    listed = F.array(*[F.lit(float(w)) for w in (weights or (1,))])
    rank = F.row_number().over(by_name) - 1
    ranked = sources.select(
        "*", F.get(listed, F.pmod(rank, F.lit(len(weights or (1,))))).alias("weight")
    ).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = F.greatest(left / F.sum("weight").over(onward), F.lit(0.0))
    filled = (
        ranked.withColumn("budget", budget)
        .withColumn("level", level)
        .withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    # All sources past the last clamped one share one level: that of the first of them.
    first_free = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "level")))
    common = first_free.over(Window.partitionBy())["level"]
    return filled.select(
        "source", "source_size",
        F.when(F.col("clamped"), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("weight") * common))
        .alias("target"),
    )


def _thresholds(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the largest hash still taken, so that the sizes up to it come nearest ``rest``.

    ``wanted`` has (source, rest): words the fractional repetition should bring.
    """
    same = F.col("d.source").eqNullSafe(F.col("w.source"))
    state = wanted.select("source", F.col("rest").cast("double"), F.lit(0).cast("long").alias("low"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        span = F.col("w.low"), F.col("w.low") + F.lit((1 << (shift + STEP_BITS)) - 1)
        inside = docs.alias("d").join(state.alias("w"), same & F.col("d.h").between(*span))
        slots = inside.groupBy(
            F.col("d.source").alias("source"), F.shiftright("d.h", shift).alias("slot"),
            F.col("w.rest").alias("rest"),
        ).agg(F.sum("d.size").alias("words"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("source").orderBy("slot")
        upto = F.sum("words").over(order)
        # The first slot whose end passes the rest holds the threshold; at the end of the last
        # step (or a slot of one document) it is in if that brings the sum nearer.
        crossing = (
            slots.withColumn("upto", upto)
            .withColumn("before", F.col("upto") - F.col("words"))
            .where("upto > rest")
            .groupBy("source")
            .agg(F.min_by(F.struct("slot", "before", "words", "rest", "n"), "slot").alias("c"))
        )
        state = stored(
            crossing.select(
                "source",
                (F.col("c.rest") - F.col("c.before")).alias("rest"),
                F.shiftleft("c.slot", shift).alias("low"),
                F.col("c.words").alias("words"),
                F.col("c.n").alias("n"),
            )
        )
        if state.where("n > 1").isEmpty():
            break
    top = F.when(F.col("words") - F.col("rest") < F.col("rest"), F.col("low") + F.lit((1 << shift) - 1))
    return state.select("source", top.otherwise(F.col("low") - 1).alias("top"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = BUDGET_SHARE,
    epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken), one row per document.

    Size is the number of words, 0 for null texts; documents without words take nothing and are
    repeated as their source is. A null source is a source of its own, ranked last. Rows with
    the same doc_id share one hash, so they are in or out together. No rows give no rows.
    """
    sized = stored(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            sampling_hash(F.col("doc_id"), seed).alias("h"),
        )
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = stored(water_fill(sources, weights, share, epochs)).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    tops = _thresholds(sized, planned.select("source", rest.alias("rest")).where("rest > 0"))
    plan = planned.join(tops, planned["source"].eqNullSafe(tops["source"]), "left").select(
        planned["source"].alias("plan_source"), "source_size", "target", "whole", "top"
    )
    extra = F.when(F.col("h") <= F.col("top"), 1).otherwise(0)
    repeats = (F.col("whole") + extra).cast("long")
    return sized.join(
        plan, sized["source"].eqNullSafe(plan["plan_source"])
    ).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"),
        (F.col("size") * repeats).alias("taken"),
    )


def op4_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source", "repeats")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, greatest((budget - coalesce(sum(cap) OVER earlier, 0.0)) / sum(weight) OVER onward, 0.0) AS level
  FROM c WINDOW
    earlier AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    onward AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size,
    CASE WHEN cap <= weight * level THEN cap
      ELSE least(cap, weight * (SELECT min_by(level, cap / weight) FROM l WHERE cap > weight * level)) END AS target
  FROM l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), u AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole,
    w.target - w.whole * w.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own < rest AND upto - rest < rest - (upto - own)))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""
