"""Result sinks and the bookkeeping that lets a sweep resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.schema import factor_names


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "append",
    partition_by: Sequence[str] = (),
) -> None:
    """Weight, cost and log tables. Run parameters are columns, never part of a file name."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def replace_partitions(
    df: DataFrame, path: str, by: Sequence[str] = ("run",), fmt: str = "parquet"
) -> None:
    """Write ``df`` in place of the partitions it has rows for; all others stay.

    Writing the same run again so leaves its rows once, whatever an interrupted attempt has left.
    """
    writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy(*by).save(path)


def matrix_rows(factor: DataFrame, rank: int, way: int, kind: str = "factor") -> DataFrame:
    """Both sides of a factor as ``(idx, c0..cR-1, side, way, kind)``."""
    sides = [
        factor.select(
            "idx",
            *[F.col(n).alias(f"c{r}") for r, n in enumerate(factor_names(s, rank))],
            F.lit(s.upper()).alias("side"),
        )
        for s in ("x", "y")
    ]
    return (
        sides[0]
        .unionByName(sides[1])
        .select("*", F.lit(way).alias("way"), F.lit(kind).alias("kind"))
    )


def write_matrix(
    factor: DataFrame,
    rank: int,
    way: int,
    path: str,
    fmt: str = "parquet",
    kind: str = "factor",
    mode: str = "append",
    **tags: object,
) -> None:
    """Factor or projection matrix, partitioned by side and way.

    CSV is header-less. Rows carry ``idx`` because a distributed table has no line order;
    files are written range-partitioned and sorted by it. With ``mode="overwrite"`` the folders of
    this matrix are replaced and all others stay.
    """
    rows = matrix_rows(factor, rank, way, kind)
    for name, value in tags.items():
        rows = rows.withColumn(name, F.lit(value))
    # kind, tags, side and way become folders; what is left in the files is idx and the values.
    folders = ["kind", *tags, "side", "way"]
    rows = rows.repartitionByRange("side", "idx").sortWithinPartitions("side", "idx")
    writer = rows.write.format(fmt).mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).save(path)


def read_matrix(
    spark: SparkSession,
    path: str,
    rank: int,
    way: int,
    fmt: str = "parquet",
    kind: str = "factor",
    **tags: object,
) -> DataFrame:
    """A matrix of :func:`write_matrix` as a factor ``(idx, x0.., y0..)``, e.g. to start a fit from.

    Folders are partitions, so only those of this matrix are read. An index of one side only raises:
    every factor has both sides of all its indices.
    """
    folders = {"kind": kind, **tags, "side": "", "way": way}
    if fmt == "csv":
        values = [f"c{r} DOUBLE" for r in range(rank)]
        kinds = [f"{k} {'STRING' if isinstance(v, str) else 'INT'}" for k, v in folders.items()]
        rows = spark.read.schema(", ".join(["idx BIGINT", *values, *kinds])).csv(path)
    else:
        rows = spark.read.format(fmt).load(path)
    for name, value in folders.items():
        if name != "side":
            rows = rows.where(F.col(name) == F.lit(value))
    sides = [
        rows.where(F.col("side") == s.upper()).select(
            "idx", *[F.col(f"c{r}").alias(n) for r, n in enumerate(factor_names(s, rank))]
        )
        for s in ("x", "y")
    ]
    both = sides[0].join(sides[1], "idx", "full")
    one_sided = F.col("x0").isNull() | F.col("y0").isNull()
    checked = F.when(one_sided, F.raise_error(F.lit("an index is missing on one side"))).otherwise(F.col("idx"))
    return both.withColumn("idx", checked.cast(sides[0].schema["idx"].dataType))


def read_factors(
    spark: SparkSession, path: str, rank: int, ways: int, fmt: str = "parquet", **tags: object
) -> list[DataFrame]:
    """The factors of all ways of one written run."""
    return [read_matrix(spark, path, rank, way, fmt, **tags) for way in range(ways)]


def run_info_table(spark: SparkSession, info: dict, final: dict) -> DataFrame:
    """Settings and outcome of one run as two JSON columns."""

    def struct(values: dict):
        return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))

    return spark.range(1).select(struct(info).alias("info"), struct(final).alias("final"))


def _store_of(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    store, jvm_path = _store_of(spark, path)
    return store.exists(jvm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    store, jvm_path = _store_of(spark, path)
    store.delete(jvm_path, True)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table of :func:`write_table` or :func:`replace_partitions`; without rows if it is not there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def completed_runs(
    spark: SparkSession, path: str, keys: Sequence[str], schema: str, fmt: str = "parquet"
) -> DataFrame:
    """Keys of the runs whose output exists; empty when nothing was written yet."""
    return read_table(spark, path, schema, fmt).select(*keys).distinct()
