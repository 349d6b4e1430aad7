"""Filters, top-n and joins that turn two cell tables into one aligned pair."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.columns import contrast_columns, split_label
from pairlens.session import cut_lineage

# A candidate set is broadcast only when its row bound times its row width stays below this.
BROADCAST_BYTES = 64 << 20
# Input partitions (or groups of them) whose top rows meet in one ranking task, and how often.
TOPN_FAN_IN, TOPN_LEVELS = 64, 3
GROUP_LIMIT_KEY = "spark.sql.optimizer.windowGroupLimitThreshold"


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_cells(
    rows: DataFrame,
    n: int,
    coords: Sequence[str],
    value: str = "value",
    tie: Sequence[Column | str] | None = None,
    by: Sequence[str] = (),
    fan_in: int = TOPN_FAN_IN,
) -> DataFrame:
    """The n largest rows (per group in ``by``), exact, ties broken by ``tie``.

    A tree over the input partitions: each one drops all but its n largest rows, ``fan_in`` of them
    meet in one task that does the same, and so on. A ranking task sees ``fan_in * n`` rows per
    group at most, however many partitions there are (up to ``fan_in ** (TOPN_LEVELS + 1)``).
    Spark only inserts the drop before a shuffle for limits up to a session threshold. For larger
    ones the result is computed at once, with the threshold raised meanwhile.
    """
    order = [F.col(value).desc(), *[_as_column(t) for t in (tie or coords)]]

    def first(df: DataFrame, *groups: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    out = rows.select("*", F.spark_partition_id().cast("bigint").alias("_part"))
    for _ in range(TOPN_LEVELS):
        out = first(out.withColumn("_part", F.floor(F.col("_part") / fan_in)), *by, "_part")
    out = first(out.drop("_part"), *by)
    conf = rows.sparkSession.conf
    before = conf.get(GROUP_LIMIT_KEY)
    if not 0 <= int(before) < n:
        return out
    conf.set(GROUP_LIMIT_KEY, str(n))
    try:
        return cut_lineage(out)
    finally:
        conf.set(GROUP_LIMIT_KEY, before)


# Ranges a column is cut into per step of a selection, and rows that may be ranked in one task.
SELECTION_SLOTS, RANKED_ROWS = 4096, 50_000


def select_top(
    rows: DataFrame,
    n: int,
    coords: Sequence[str],
    value: str = "value",
    tie: Sequence[Column | str] | None = None,
    slots: int = SELECTION_SLOTS,
    ranked: int = RANKED_ROWS,
) -> DataFrame:
    """The n largest rows, exact, ties broken by ``tie`` (ascending), found by counting.

    Rows are counted in equal ranges of the value, which is an aggregate with map-side sums. All rows
    above the range that holds the n-th one are in; that range is cut again, and where all its values
    are equal the tie columns go on in the same way, until no more than ``ranked`` rows are left to be
    ranked. Nothing is shuffled but counts and those few rows, whatever n and the number of partitions.
    ``rows`` are read once per step, three times as a rule, so they should be held. Values have to be
    finite; rows without a value take no part, and tie columns must not be null. Of rows equal in all
    columns any are taken.
    """
    order = [(F.col(value).cast("double"), True)]
    order += [(_as_column(t).cast("double"), False) for t in (tie or coords)]
    rows = rows.where(F.col(value).isNotNull())
    sure, within, left = [], F.lit(True), n
    narrowed = False
    for column, descending in order:
        stats = rows.where(within).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).collect()[0]
        count, low, high = stats.n, stats.low, stats.high
        if count <= left:
            return rows.where(_any([*sure, within]))
        if not all(math.isfinite(v) for v in (low, high)):
            raise ValueError(f"values between {low} and {high} cannot be selected by ranges")
        while low < high and count > ranked:
            # Halves are finite where the width of the range is not.
            half = high / 2 - low / 2
            share = (column / 2 - F.lit(low / 2)) / F.lit(half or 1.0)
            slot = F.least(F.floor(share * slots), F.lit(slots - 1)).cast("int")
            if not half:
                slot = F.when(column > F.lit(low), 1).otherwise(0)
            found = (
                rows.where(within).groupBy(slot.alias("slot"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
                .collect()
            )
            for part in sorted(found, key=lambda r: -r.slot if descending else r.slot):
                if part.n >= left:
                    break
                left -= part.n
            before = column > part.high if descending else column < part.low
            sure.append(within & before)
            within = within & column.between(part.low, part.high)
            count, low, high = part.n, part.low, part.high
            narrowed = True
        if count <= ranked:
            break
    directions = [c.desc() if d else c.asc() for c, d in order]
    last = rows.where(within).orderBy(*directions).limit(left) if count <= ranked else rows.where(within).limit(left)
    return rows.where(_any(sure)).unionByName(last) if narrowed else last


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def candidate_cells(x_top: DataFrame, y_top: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Cells that are in either side's top list."""
    return x_top.select(*coords).unionByName(y_top.select(*coords)).distinct()


def last_wins(
    rows: DataFrame, coords: Sequence[str], order: Column | str, value: str = "value"
) -> DataFrame:
    """One row per cell; of duplicates the one latest in ``order`` is kept."""
    return rows.groupBy(*coords).agg(F.max_by(value, _as_column(order)).alias(value))


def unique_or_raise(rows: DataFrame, coords: Sequence[str], value: str = "value") -> DataFrame:
    """Strict form of :func:`last_wins`: a duplicated cell raises."""
    grouped = rows.groupBy(*coords).agg(
        F.count(F.lit(1)).alias("_n"), F.max(value).alias(value)
    )
    message = F.concat(F.lit("duplicate cell "), F.concat_ws("_", *coords))
    return grouped.withColumn(
        value, F.when(F.col("_n") > 1, F.raise_error(message).cast("double")).otherwise(F.col(value))
    ).drop("_n")


def members(rows: DataFrame, candidates: DataFrame, coords: Sequence[str], bound: int | None = None):
    """Rows whose cell is a candidate. ``bound`` is a proven row bound of ``candidates``."""
    row_bytes = 8 * (len(coords) + 1)
    if bound is not None and bound * row_bytes <= BROADCAST_BYTES:
        candidates = F.broadcast(candidates)
    return rows.join(candidates, list(coords), "left_semi")


def aligned(
    candidates: DataFrame,
    x_rows: DataFrame,
    y_rows: DataFrame,
    coords: Sequence[str],
    value: str = "value",
    order: Column | str | None = None,
    candidate_bound: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """``(coords, x, y)`` for every candidate, read from the full sides, zero where absent.

    The sides are cut down to candidate cells first, so only candidate-sized data is
    de-duplicated and joined.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        kept = members(rows, candidates, coords, candidate_bound)
        if strict:
            kept = unique_or_raise(kept, coords, value)
        elif order is not None:
            kept = last_wins(kept, coords, order, value)
        return kept.select(*coords, F.col(value).alias(name))

    zero = F.lit(0.0)
    return (
        candidates.join(side(x_rows, "x"), list(coords), "left")
        .join(side(y_rows, "y"), list(coords), "left")
        .select(*coords, F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))
    )


def aligned_full(
    x_rows: DataFrame, y_rows: DataFrame, coords: Sequence[str], value: str = "value"
) -> DataFrame:
    """Every cell of either side.

    Written as union + group-by, which equals a full outer join when each side holds a cell
    once: one shuffle for both sides with map-side merging, and no join partition to skew.
    """
    zero = F.lit(0.0)
    tagged = x_rows.select(*coords, F.col(value).alias("x"), zero.alias("y")).unionByName(
        y_rows.select(*coords, zero.alias("x"), F.col(value).alias("y"))
    )
    return tagged.groupBy(*coords).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def signals(pair: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Add the three contrast signals to aligned cells."""
    derived = contrast_columns(F.col("x"), F.col("y"))
    return pair.select(*coords, *[c.alias(name) for name, c in derived.items()])


def with_split(cells: DataFrame, coords: Sequence[str], train_tenths: float, seed: int = 2):
    return cells.withColumn(
        "split", split_label([F.col(c) for c in coords], train_tenths, seed)
    )


def subset(cells: DataFrame, label: str) -> DataFrame:
    return cells.where(F.col("split") == label)


def in_box(ranges: dict[str, tuple[int, int]]) -> Column:
    """Half-open axis-aligned box as one predicate (pushed to the scan by Catalyst)."""
    condition = F.lit(True)
    for name, (low, high) in ranges.items():
        condition = condition & (F.col(name) >= low) & (F.col(name) < high)
    return condition


def block_columns(dims: Sequence[int], blocks_per_way: int) -> list[Column]:
    """Block number of each way when it is cut into ``blocks_per_way`` equal ranges."""
    widths = [-(-d // blocks_per_way) for d in dims]
    return [
        F.floor(F.col(f"i{w}") / F.lit(width)).cast("int").alias(f"b{w}")
        for w, width in enumerate(widths)
    ]


def block_share(cells: DataFrame, dims: Sequence[int], blocks_per_way: int) -> DataFrame:
    """Cells per block and their share; empty blocks give no row."""
    names = [f"b{w}" for w in range(len(dims))]
    counts = cells.select(*block_columns(dims, blocks_per_way)).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    # blocks_per_way ** ways rows at most, so the total is a window over the counts.
    total = F.sum("n_cells").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n_cells").cast("double") / total.cast("double"))
