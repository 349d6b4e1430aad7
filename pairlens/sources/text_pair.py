"""Text source that keeps coordinates and values in two line-aligned file sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions.columns import coord_fields
from pairlens.operators.align import aligned, candidate_cells, select_top, signals
from pairlens.schema import PairedTensor, coord_names
from pairlens.session import cut_lineage, hold

# Folder of each case family as laid out by the exporting job.
CASE_FOLDERS = {
    ("wpi_", False): "attempt_kc_response",
    ("wpi_", True): "problem_name_kc_problem_view_duration",
    ("ha_", False): "education_country_daysq",
    ("ha_", True): "education_country_daysq_age",
}
DEFAULT_FOLDER = "timeHashing_hour_locationHashing"


@dataclass(frozen=True)
class CaseLayout:
    """Where the exported file pairs of a case study live."""

    root: str
    folders: dict = field(default_factory=lambda: dict(CASE_FOLDERS))
    default_folder: str = DEFAULT_FOLDER

    def folder(self, case: str) -> str:
        for (prefix, four_way), name in self.folders.items():
            if case.startswith(prefix) and case.endswith("4d") == four_way:
                return name
        return self.default_folder

    def glob(self, kind: str, source: str, domain: str, type_: str, case: str, seed: int) -> str:
        """``kind`` is "dimensions" or "values". Seed 1 must not pick up the files of seed 10."""
        stem = f"{domain}_{type_}_{kind}_grid_{case}_{seed}"
        base = f"{self.root}/output/{self.folder(case)}/exportR/{source}"
        return f"{base}/{{{stem},{stem}[^0-9]*}}"


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position in the whole file set: ``(pos BIGINT, value STRING)``.

    Files are ordered by path. A split is read front to back by one task, so the position of
    a line is (lines in earlier files) + (lines in earlier splits of its file) + (its rank in
    the split), and the last is a difference of ``monotonically_increasing_id``. Only one row
    per split is ever sorted, never the lines themselves.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("mid"),
    )
    splits = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("lines"), F.min("mid").alias("first_mid")
    )
    files = splits.groupBy("file").agg(F.sum("lines").alias("file_lines"))
    # One row per file / per split: the windows below never see a data row.
    before_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before_split = (
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )
    files = files.select(
        "file", F.coalesce(F.sum("file_lines").over(before_file), F.lit(0)).alias("file_offset")
    )
    offsets = splits.join(files, "file").select(
        "file",
        "start",
        "first_mid",
        (
            F.col("file_offset")
            + F.coalesce(F.sum("lines").over(before_split), F.lit(0))
        ).alias("offset"),
    )
    return lines.join(offsets, ["file", "start"]).select(
        (F.col("offset") + F.col("mid") - F.col("first_mid")).alias("pos"), "value"
    )


def positional_zip(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Pair row n with row n. A position present on one side only raises.

    The check sits in a filter, so column pruning downstream cannot remove it.
    """
    joined = left.withColumn("_l", F.lit(True)).join(
        right.withColumn("_r", F.lit(True)), pos, "full_outer"
    )
    message = F.concat(F.lit("no line-aligned partner at position "), F.col(pos).cast("string"))
    unpaired = F.col("_l").isNull() | F.col("_r").isNull()
    return joined.where(
        F.when(unpaired, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).drop("_l", "_r")


def read_text_pair(
    spark: SparkSession, coordinate_path: str, value_path: str, ways: int
) -> DataFrame:
    """``(pos, i0..iN-1, value)``, one row per line; duplicates are still present."""
    coordinates = read_numbered_lines(spark, coordinate_path).select(
        "pos", *coord_fields(F.col("value"), ways)
    )
    values = read_numbered_lines(spark, value_path).select(
        "pos", F.col("value").cast("double").alias("value")
    )
    return positional_zip(coordinates, values)


def load_paired(
    x_rows: DataFrame,
    y_rows: DataFrame,
    dims: tuple[int, ...],
    n: int,
    order: Column | str = "pos",
    strict: bool = False,
) -> PairedTensor:
    """Both sides' rows -> top-n candidates -> aligned cells with contrast signals.

    The sides are held while the at most 2 n cells are made, so their sources are read once; the cells
    are checkpointed and the sides let go.
    """
    coords = coord_names(len(dims))
    x_rows, y_rows = hold(x_rows), hold(y_rows)
    x_top = select_top(x_rows, n, coords, tie=[order])
    y_top = select_top(y_rows, n, coords, tie=[order])
    candidates = candidate_cells(x_top, y_top, coords)
    pair = aligned(
        candidates, x_rows, y_rows, coords, order=order, candidate_bound=2 * n, strict=strict
    )
    cells = cut_lineage(signals(pair, coords))
    for rows in (x_rows, y_rows):
        rows.unpersist()
    return PairedTensor(cells, tuple(dims))


def load_case(
    spark: SparkSession,
    layout: CaseLayout,
    case: str,
    dims: tuple[int, ...],
    domain: str,
    type_: str = "function",
    sources: tuple[str, str] = ("good", "bad"),
    n: int = 40000,
    seed: int = 0,
    strict: bool = False,
) -> PairedTensor:
    """Both sides of an exported case study for one bootstrap sample."""
    sides = []
    for source in sources:
        paths = [
            layout.glob(kind, source, domain, type_, case, seed) for kind in ("dimensions", "values")
        ]
        sides.append(read_text_pair(spark, *paths, len(dims)))
    return load_paired(*sides, dims, n, strict=strict)
