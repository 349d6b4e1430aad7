from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions.columns import decode_key, encode_key, floor_below, split_label
from pairlens.operators.align import (
    aligned,
    aligned_full,
    block_share,
    candidate_cells,
    in_box,
    last_wins,
    select_top,
    signals,
    top_cells,
    unique_or_raise,
    with_split,
)
from pairlens.schema import coord_names, dims_of
from pairlens.sources.facts import read_cells
from pairlens.sources.text_pair import (
    CaseLayout,
    load_case,
    load_paired,
    positional_zip,
    read_numbered_lines,
    read_text_pair,
)

C3 = coord_names(3)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def write_lines(folder, parts):
    os.makedirs(folder)
    for i, lines in enumerate(parts):
        with open(f"{folder}/part-{i:05d}", "w") as f:
            f.writelines(line + "\n" for line in lines)


@pytest.fixture
def pair(spark):
    """Only in X, only in Y, equal, and equal up to the tolerance."""
    x = spark.createDataFrame(
        [(0, 0, 0, 5.0), (0, 1, 0, 2.0), (1, 1, 1, 3.0)], "i0 INT, i1 INT, i2 INT, value DOUBLE"
    )
    y = spark.createDataFrame(
        [(1, 0, 0, 4.0), (0, 1, 0, 2.0), (1, 1, 1, 3.000001)], "i0 INT, i1 INT, i2 INT, value DOUBLE"
    )
    return x, y


def test_full_alignment_and_signals(pair):
    cells = signals(aligned_full(*pair, C3), C3)
    got = rows(cells, "i0", "i1", "i2", "x", "y", "s")
    assert got == [
        (0, 0, 0, 5.0, 0.0, 0),
        (0, 1, 0, 2.0, 2.0, 1),
        (1, 0, 0, 0.0, 4.0, 0),
        (1, 1, 1, 3.0, 3.000001, 1),
    ]
    by_cell = {(r.i0, r.i1, r.i2): r for r in cells.collect()}
    assert by_cell[(0, 0, 0)].zx == 5.0 and by_cell[(0, 0, 0)].zy == 0.0
    assert by_cell[(1, 0, 0)].zy == 4.0 and by_cell[(1, 1, 1)].zx == 0.0
    assert dims_of(cells, 3) == (2, 2, 2)


def test_top_cells_breaks_ties_and_is_exact(spark):
    data = [(i, i % 7, 0, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(data, "i0 INT, i1 INT, i2 INT, value DOUBLE").repartition(7)
    got = rows(top_cells(df, 50, C3), "i0")
    want = sorted(r[0] for r in sorted(data, key=lambda r: (-r[3], r[0]))[:50])
    assert [g[0] for g in got] == want


def test_top_cells_leaves_the_session_as_it_was(spark):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, "10")
    df = spark.range(100).selectExpr("CAST(id AS INT) i0", "0 i1", "0 i2", "CAST(id AS DOUBLE) value")
    top = top_cells(df, 50, C3)
    assert spark.conf.get(key) == "10"
    assert sorted(r.i0 for r in top.collect()) == list(range(50, 100))
    spark.conf.unset(key)
    small = top_cells(df, 50, C3)
    assert "WindowGroupLimit" in small._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_top_cells_as_a_tree(spark, parts):
    data = [(i, (i * 37) % 3, 0, float(i * 7919 % 101)) for i in range(400)]
    df = spark.createDataFrame(data, "i0 INT, i1 INT, i2 INT, value DOUBLE").repartition(parts)
    got = sorted(r.i0 for r in top_cells(df, 20, C3, fan_in=2).collect())
    assert got == sorted(r[0] for r in sorted(data, key=lambda r: (-r[3], r[0]))[:20])
    by = top_cells(df, 5, C3, by=["i1"], fan_in=3).groupBy("i1").count().collect()
    assert {r["i1"]: r["count"] for r in by} == {0: 5, 1: 5, 2: 5}


def test_hot_cell_does_not_displace_others(spark):
    """A third of all rows are copies of one cell; the rest keep their ranks."""
    hot = spark.range(3000).selectExpr("7 i0", "7 i1", "7 i2", "CAST(1 AS DOUBLE) value")
    rest = spark.range(6000).selectExpr(
        "CAST(id AS INT) + 10 i0", "1 i1", "1 i2", "CAST(2 + id % 10 AS DOUBLE) value"
    )
    got = top_cells(hot.union(rest), 6500, C3)
    assert got.where("i0 >= 10").count() == 6000
    assert got.where("i0 = 7").count() == 500


def test_value_outside_own_top_list_is_kept(pair):
    x, y = pair
    top_x, top_y = top_cells(x, 1, C3), top_cells(y, 1, C3)
    cells = aligned(candidate_cells(top_x, top_y, C3), x, y, C3, candidate_bound=2)
    assert rows(cells, *C3, "x", "y") == [(0, 0, 0, 5.0, 0.0), (1, 0, 0, 0.0, 4.0)]
    # (1,1,1) enters through X at n=2 and still gets Y's true value.
    wider = aligned(candidate_cells(top_cells(x, 2, C3), top_y, C3), x, y, C3)
    assert (1, 1, 1, 3.0, 3.000001) in rows(wider, *C3, "x", "y")


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 1.0, 0), (0, 0, 0, 9.0, 2), (0, 0, 0, 5.0, 1), (1, 0, 0, 2.0, 3)],
        "i0 INT, i1 INT, i2 INT, value DOUBLE, pos LONG",
    )
    assert rows(last_wins(df, C3, "pos"), "i0", "value") == [(0, 9.0), (1, 2.0)]
    with pytest.raises(Exception, match="duplicate cell"):
        unique_or_raise(df, C3).collect()


def test_codec(spark):
    df = spark.createDataFrame([("3,0,12",)], "line STRING")
    row = df.select(encode_key(F.col("line")).alias("k")).select("k", decode_key(F.col("k")).alias("d")).first()
    assert row.k == "3_0_12" and row.d == [3, 0, 12]


def test_floor_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1e-17,), (-3.0,), (2.0,)], "v DOUBLE")
    got = [r[0] for r in df.select(floor_below(F.col("v"), 0.0)).collect()]
    assert got[0] != got[0] and got[1:] == [0.0, 0.0, 2.0]


def test_split_is_a_partition_and_ignores_layout(spark):
    df = spark.range(5000).selectExpr("CAST(id % 50 AS INT) i0", "CAST(id / 50 AS INT) i1", "3 i2")
    one = with_split(df, C3, 6.0)
    counts = {r.split: r["count"] for r in one.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000 and 2500 < counts["train"] < 3500
    assert rows(one, *C3, "split") == rows(with_split(df.repartition(13), C3, 6.0), *C3, "split")
    assert df.select(split_label([F.col(c) for c in C3], 10.0).alias("l")).distinct().collect()[0].l == "train"


def test_box_and_blocks(spark):
    df = spark.range(60).selectExpr(
        "CAST(id % 5 AS INT) i0", "CAST(id / 5 % 4 AS INT) i1", "CAST(id / 20 AS INT) i2"
    )
    assert df.where(in_box({"i0": (1, 3), "i2": (0, 1)})).count() == 8
    shares = block_share(df, (5, 4, 3), 2)
    # Every cell is in exactly one block.
    assert shares.agg(F.sum("n_cells")).first()[0] == 60
    assert abs(shares.agg(F.sum("share")).first()[0] - 1.0) < 1e-12


def test_numbered_lines_across_files_and_splits(spark, tmp_path):
    folder = str(tmp_path / "lines")
    lines = [[f"{p}-{n}" for n in range(700)] for p in range(3)]
    write_lines(folder, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [r.value for r in read_numbered_lines(spark, folder).orderBy("pos").collect()]
        positions = sorted(r.pos for r in read_numbered_lines(spark, folder).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [line for part in lines for line in part]
    assert positions == list(range(2100))


def test_text_pair_end_to_end(spark, tmp_path):
    coords_dir, values_dir = str(tmp_path / "c"), str(tmp_path / "v")
    # Last line repeats the first cell; two ties at 3.0.
    write_lines(coords_dir, [["0,0,0", "1,0,0"], ["2,0,1", "3,1,1"], ["0,0,0"]])
    write_lines(values_dir, [["5", "3.0"], ["3.0", "1"], ["4.5"]])
    df = read_text_pair(spark, coords_dir, values_dir, 3)
    assert rows(df, "pos", *C3, "value")[-1] == (4, 0, 0, 0, 4.5)
    y = spark.createDataFrame([(0, 3, 1, 1, 8.0)], "pos LONG, i0 INT, i1 INT, i2 INT, value DOUBLE")
    # n=3: both copies of (0,0,0) take a slot and the earlier of the two ties the third.
    t = load_paired(df, y, (4, 2, 2), 3)
    assert rows(t.cells, *C3, "x", "y") == [
        (0, 0, 0, 4.5, 0.0), (1, 0, 0, 3.0, 0.0), (3, 1, 1, 1.0, 8.0)
    ]
    with pytest.raises(Exception, match="duplicate cell"):
        load_paired(df, y, (4, 2, 2), 3, strict=True).cells.collect()


def test_line_count_mismatch_raises_even_if_pos_is_unused(spark, tmp_path):
    coords_dir, values_dir = str(tmp_path / "c"), str(tmp_path / "v")
    write_lines(coords_dir, [["0,0,0", "1,0,0"]])
    write_lines(values_dir, [["5"]])
    df = read_text_pair(spark, coords_dir, values_dir, 3)
    with pytest.raises(Exception, match="no line-aligned partner"):
        df.select("i0").collect()


def test_bad_text_raises(spark, tmp_path):
    write_lines(str(tmp_path / "c"), [["0,0,x"]])
    write_lines(str(tmp_path / "v"), [["5"]])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_text_pair(spark, str(tmp_path / "c"), str(tmp_path / "v"), 3).collect()


def test_zip_of_tables(spark):
    left = spark.range(5).withColumnRenamed("id", "pos")
    assert positional_zip(left, left.withColumn("v", F.col("pos") * 2)).count() == 5


def test_case_layout_and_seed_glob(spark, tmp_path):
    layout = CaseLayout(str(tmp_path))
    assert layout.folder("wpi_5mp4d") == "problem_name_kc_problem_view_duration"
    assert layout.folder("wpi_5") == "attempt_kc_response"
    assert layout.folder("ha_1mp4d") == "education_country_daysq_age"
    assert layout.folder("nyc") == "timeHashing_hour_locationHashing"
    base = tmp_path / "output" / layout.folder("nyc") / "exportR" / "good"
    base.mkdir(parents=True)
    for seed in ("1", "10", "1_a"):
        (base / f"math_function_dimensions_grid_nyc_{seed}").write_text("x\n")
    read = spark.read.text(layout.glob("dimensions", "good", "math", "function", "nyc", 1))
    assert read.count() == 2
    assert len(glob.glob(f"{base}/*")) == 3


def test_one_file_source(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, 4.0)], "i0 INT, i1 INT, i2 INT, value DOUBLE")
    df.write.parquet(str(tmp_path / "p"))
    df.write.csv(str(tmp_path / "c"), header=True)
    for fmt, name, opts in (("parquet", "p", {}), ("csv", "c", {"header": "true"})):
        got = read_cells(spark, str(tmp_path / name), 3, fmt, **opts)
        assert rows(got, *C3, "value") == [(1, 2, 3, 4.0)]


def test_case_study_from_exported_files(spark, tmp_path):
    """Two sides, dimension and value files, seed 1 beside seed 10."""
    layout = CaseLayout(str(tmp_path))
    for source, value in (("good", 2.0), ("bad", 5.0)):
        base = tmp_path / "output" / layout.folder("ha_1mp4d") / "exportR" / source
        base.mkdir(parents=True)
        for seed in (1, 10):
            stem = f"ha_1mp4d_{seed}"
            (base / f"mooc_function_dimensions_grid_{stem}").write_text(f"{seed % 10},0,0\n1,1,1\n")
            (base / f"mooc_function_values_grid_{stem}").write_text(f"{value}\n{seed}\n")
    t = load_case(spark, layout, "ha_1mp4d", (2, 2, 2), "mooc", n=10, seed=1)
    assert rows(t.cells, *C3, "x", "y", "s") == [(1, 0, 0, 2.0, 5.0, 0), (1, 1, 1, 1.0, 1.0, 1)]


@pytest.mark.parametrize("slots,ranked", [(4096, 50_000), (4, 3), (2, 0)])
def test_selection_by_ranges_equals_sorting(spark, slots, ranked):
    """Ties, repeated rows, negative and equal values, nulls, and n around every boundary."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), rng.randint(0, 9), rng.choice([-1e300, -2.5, 0.0, 1.0, 1.0, 7.25, 1e300])) for _ in range(90)]
    rows = list({(i, j): v for i, j, v in rows}.items())
    rows = [(i, j, v) for (i, j), v in rows] + [(7, 7, None)]
    df = spark.createDataFrame(rows, "i0 INT, i1 INT, value DOUBLE").repartition(5).persist()
    order = sorted([r for r in rows if r[2] is not None], key=lambda r: (-r[2], r[0], r[1]))
    for n in (0, 1, 9, 20, len(order) - 1, len(order), 500):
        got = select_top(df, n, ["i0", "i1"], slots=slots, ranked=ranked)
        assert sorted(map(tuple, got.collect())) == sorted(order[:n]), n
    same = spark.createDataFrame([(1, 1, 2.0)] * 8 + [(0, 0, 3.0)], "i0 INT, i1 INT, value DOUBLE")
    assert select_top(same, 4, ["i0", "i1"], slots=slots, ranked=ranked).count() == 4
    assert select_top(df.limit(0), 4, ["i0", "i1"]).count() == 0
    endless = spark.createDataFrame([(0, 0, float("inf")), (1, 1, 2.0)], "i0 INT, i1 INT, value DOUBLE")
    with pytest.raises(ValueError, match="ranges"):
        select_top(endless, 1, ["i0", "i1"])
