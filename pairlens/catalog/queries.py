"""Registered queries: one per operator, over the given tables, each with its SQL twin."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog import oracles as sql
from pairlens.functions.columns import clamp, decode_key, encode_key, floor_below
from pairlens.operators import algebra as al
from pairlens.operators.align import (
    aligned,
    aligned_full,
    block_share,
    candidate_cells,
    in_box,
    last_wins,
    members,
    select_top,
    signals,
    subset,
    top_cells,
    with_split,
)
from pairlens.operators.weights import normalize_weights, tag, widen_weights
from pairlens.plans.baseline import baseline
from pairlens.plans.fit import FitConfig, FitState, Workspace, fit, fit_runs, start_state
from pairlens.plans.pairwise import pairwise, update_way
from pairlens.plans.sweep import (
    RUN_KEY_SCHEMA,
    RUN_KEYS,
    committed,
    cost_delta,
    holdout_rmse,
    pending_runs,
    run_grid,
    run_name,
    run_sweep,
)
from pairlens.schema import PairedTensor, coord_names, factor_columns
from pairlens.operators.gather import plan_joins
from pairlens.session import cut_lineage, ensure_checkpoint_dir
from pairlens.sources.facts import read_cells
from pairlens.sources.sinks import read_factors, remove_path, write_matrix
from pairlens.sources.text_pair import CaseLayout, load_case, positional_zip, read_text_pair

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

RANK = fx.RANK
FIT_RANK, FIT_ITERATIONS, FIT_COMMON = 3, 2, 2
TOP_N = 4000
CASE_TOP_N = 500
TENTHS = 6.0


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, oracle)
        return fn

    return add


def _factors(spark: SparkSession, t: PairedTensor, rank: int = RANK) -> list[DataFrame]:
    return al.init_factors(spark, t.dims, rank, fx.SEED)


def _rounded(df: DataFrame, digits: int, names: list[str]) -> DataFrame:
    return df.selectExpr(
        *[f"round({c}, {digits}) + 0.0D AS {c}" if c in names else c for c in df.columns]
    )


def _round_except(df: DataFrame, digits: int, *keys: str) -> DataFrame:
    return _rounded(df, digits, [c for c in df.columns if c not in keys])


# --- sources and alignment -------------------------------------------------

@query("pair_from_facts", sql.ORDER4_PAIR)
def _(spark, d):
    return fx.order4_pair(spark, d)


@query("pair_from_events", sql.EVENT3_PAIR)
def _(spark, d):
    return fx.event3_pair(spark, d)


@query("pair_high_cardinality", sql.LINE3_PAIR)
def _(spark, d):
    return fx.line3_pair(spark, d)


@query("contrast_signals", sql.signals_sql("order4", f"({sql.ORDER4_PAIR})"))
def _(spark, d):
    return fx.order4(spark, d).cells


def _sides(pair: DataFrame, coords: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(
        pair.where(F.col(s) > 0).select(*coords, F.col(s).alias("value")) for s in ("x", "y")
    )


@query("full_alignment", f"select i0, i1, i2, x, y from ({sql.LINE3_PAIR}) where x > 0 or y > 0")
def _(spark, d):
    coords = coord_names(3)
    return aligned_full(*_sides(fx.line3_pair(spark, d), coords), coords)


@query("topn_candidates", sql.candidates_oracle("order4", TOP_N))
def _(spark, d):
    coords = coord_names(4)
    sides = _sides(cut_lineage(fx.order4_pair(spark, d)), coords)
    return candidate_cells(*[select_top(s, TOP_N, coords) for s in sides], coords)


@query("paired_topn", sql.paired_topn_oracle("order4", TOP_N))
def _(spark, d):
    coords = coord_names(4)
    x_rows, y_rows = _sides(cut_lineage(fx.order4_pair(spark, d)), coords)
    candidates = candidate_cells(
        select_top(x_rows, TOP_N, coords), select_top(y_rows, TOP_N, coords), coords
    )
    pair = aligned(candidates, x_rows, y_rows, coords, candidate_bound=2 * TOP_N)
    return signals(pair, coords)


@query(
    "topn_per_group",
    "select i0, i1, i2, i3, x as value from (select *, row_number() over (partition by i0 "
    f"order by x desc, i1, i2, i3) as rn from ({sql.ORDER4_PAIR}) where x > 0) where rn <= 20",
)
def _(spark, d):
    coords = coord_names(4)
    x_rows, _y = _sides(fx.order4_pair(spark, d), coords)
    return top_cells(x_rows, 20, coords, by=["i0"]).select(*coords, "value")


@query(
    "candidate_members",
    sql.with_(
        sql.topn_ctes("order4", TOP_N),
        "select i0, i1, i2, i3, x as value from pair where x > 0 and "
        "(i0, i1, i2, i3) in (select (i0, i1, i2, i3) from cand)",
    ),
)
def _(spark, d):
    coords = coord_names(4)
    x_rows, y_rows = _sides(fx.order4_pair(spark, d), coords)
    candidates = candidate_cells(
        top_cells(x_rows, TOP_N, coords), top_cells(y_rows, TOP_N, coords), coords
    )
    return members(x_rows, candidates, coords, 2 * TOP_N).select(*coords, "value")


@query(
    "coord_codec",
    "select line, concat_ws('_', i0, i1, i2) as key, i0 as d0, i1 as d1, i2 as d2 from "
    f"(select *, concat_ws(',', i0, i1, i2) as line from ({sql.LINE3_PAIR}))",
)
def _(spark, d):
    lines = fx.line3_pair(spark, d).select(F.concat_ws(",", *coord_names(3)).alias("line"))
    keyed = lines.withColumn("key", encode_key(F.col("line")))
    decoded = decode_key(F.col("key"))
    return keyed.select("line", "key", *[decoded.getItem(w).alias(f"d{w}") for w in range(3)])


@query(
    "positional_zip",
    "select o_orderkey as pos, cast(o_custkey as int) as i0, "
    "cast(substr(o_orderpriority, 1, 1) as int) - 1 as i1, o_totalprice as value from orders",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders")
    left = orders.select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").cast("int").alias("i0"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("i1"),
    )
    right = orders.select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("value"))
    return positional_zip(left, right)


@query("text_pair_source", f"select i0, i1, i2, x as value from ({sql.LINE3_PAIR}) where x > 0")
def _(spark, d):
    """Export the X side as line-aligned coordinate and value files, then read it back."""
    out = f"{ensure_checkpoint_dir(spark)}/text-pair-{uuid.uuid4().hex}"
    coords = coord_names(3)
    x_rows, _y = _sides(fx.line3_pair(spark, d), coords)
    # Key-partitioned and sorted: both exports put the same cell on the same line.
    ordered = x_rows.repartition(4, *coords).sortWithinPartitions(*coords)
    ordered.select(F.concat_ws(",", *coords)).write.text(f"{out}/dimensions_grid")
    ordered.select(F.col("value").cast("string")).write.text(f"{out}/values_grid")
    return read_text_pair(spark, f"{out}/dimensions_grid", f"{out}/values_grid", 3).drop("pos")


def _export_sides(spark: SparkSession, pair: DataFrame, ways: int, path_of) -> None:
    """Both sides as line-aligned coordinate and value files, in the order of their coordinates."""
    coords = coord_names(ways)
    for source, rows in zip(("good", "bad"), _sides(pair, coords)):
        ordered = rows.repartitionByRange(4, *coords).sortWithinPartitions(*coords)
        ordered.select(F.concat_ws(",", *coords)).write.text(path_of("dimensions", source))
        ordered.select(F.col("value").cast("string")).write.text(path_of("values", source))


@query("load_case", sql.paired_topn_oracle("event3", CASE_TOP_N))
def _(spark, d):
    """Both sides of an exported case, found by its layout: top-n, last line wins, signals."""
    layout = CaseLayout(f"{ensure_checkpoint_dir(spark)}/case-{uuid.uuid4().hex}")
    glob = lambda kind, source: layout.glob(kind, source, "events", "function", "by_user", 1)
    # The first alternative of the glob is the plain name.
    path = lambda kind, source: re.sub(r"\{([^,]*),.*\}$", r"\1", glob(kind, source))
    _export_sides(spark, fx.event3_pair(spark, d), 3, path)
    return load_case(spark, layout, "by_user", fx.EVENT3_DIMS, "events", n=CASE_TOP_N, seed=1).cells


@query("one_file_source", sql.ORDER4_PAIR)
def _(spark, d):
    """The pair written as one CSV file set and read back with its stated schema."""
    path = f"{ensure_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    fx.order4_pair(spark, d).write.option("header", True).csv(path)
    return read_cells(spark, path, 4, "csv", ("x", "y"), header="true")


@query(
    "last_wins",
    "select cast(user_id % 16 as int) as i0, case event_type when 'click' then 0 when 'error' "
    "then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as i1, "
    "cast(extract(hour from ts) as int) as i2, arg_max(value, event_id) as value "
    "from events group by 1, 2, 3",
)
def _(spark, d):
    rows = fx.table(spark, d, "events").select(
        F.pmod("user_id", F.lit(16)).cast("int").alias("i0"),
        fx._code("event_type", fx.EVENT_TYPES).alias("i1"),
        F.hour("ts").alias("i2"),
        "event_id",
        "value",
    )
    return last_wins(rows, coord_names(3), "event_id")


@query("holdout_split", sql.split_oracle("order4", TENTHS))
def _(spark, d):
    coords = coord_names(4)
    return with_split(fx.order4_pair(spark, d), coords, TENTHS).select(*coords, "split")


@query("train_subset", sql.train_subset_oracle("line3", TENTHS))
def _(spark, d):
    coords = coord_names(3)
    labelled = with_split(fx.line3_pair(spark, d), coords, TENTHS)
    return subset(labelled, "train").select(*coords, "x", "y")


@query(
    "box_filter",
    f"select * from ({sql.ORDER4_PAIR}) where i0 >= 5 and i0 < 15 and i1 >= 0 and i1 < 12 and i3 >= 2 and i3 < 5",
)
def _(spark, d):
    return fx.order4_pair(spark, d).where(in_box({"i0": (5, 15), "i1": (0, 12), "i3": (2, 5)}))


@query(
    "block_share",
    "select cast(i0 // 13 as int) as b0, cast(i1 // 13 as int) as b1, cast(i2 // 3 as int) as b2, "
    "cast(i3 // 3 as int) as b3, count(*) as n_cells, cast(count(*) as double) / "
    f"cast(sum(count(*)) over () as double) as share from ({sql.ORDER4_PAIR}) group by 1, 2, 3, 4",
)
def _(spark, d):
    return block_share(fx.order4_pair(spark, d), fx.ORDER4_DIMS, 2)


@query(
    "clamp_and_floor",
    "select event_id, greatest(value - 50, 0.0) as clamped, case when value - 50 < "
    "cast(1e-16 as double) then cast(1e-16 as double) else value - 50 end as floored from events",
)
def _(spark, d):
    shifted = F.col("value") - 50
    return fx.table(spark, d, "events").select(
        "event_id", clamp(shifted).alias("clamped"), floor_below(shifted, 1e-16).alias("floored")
    )


# --- algebra ---------------------------------------------------------------

@query(
    "tensor_norms",
    "select round(sqrt(sum(x * x)), 4) as norm_x, round(sqrt(sum(y * y)), 4) as norm_y "
    f"from ({sql.LINE3_PAIR})",
)
def _(spark, d):
    return _round_except(al.tensor_norms(fx.line3_pair(spark, d)), 4)


def _register_mttkrp(way: int) -> None:
    @query(f"mttkrp_way{way}", sql.mttkrp_oracle("order4", way, RANK))
    def _(spark, d):
        t = fx.order4(spark, d)
        return _round_except(al.mttkrp(t, _factors(spark, t), RANK, way), 4, "idx")


for _way in range(4):
    _register_mttkrp(_way)


@query("mttkrp_single", sql.mttkrp_oracle("event3", 1, RANK, sql.FUSED[:1]))
def _(spark, d):
    t = fx.event3(spark, d)
    out = al.mttkrp(t, _factors(spark, t), RANK, 1, al.FUSED_TERMS[:1])
    return _round_except(out, 4, "idx")


@query("mttkrp_fused", sql.completed_oracle("line3", 0, RANK))
def _(spark, d):
    t = fx.line3(spark, d)
    factors = _factors(spark, t)
    done = al.complete(factors[0].select("idx"), al.mttkrp(t, factors, RANK, 0))
    return _round_except(done, 4, "idx")


@query("mttkrp_fibres", sql.mttkrp_oracle("order4", 0, RANK))
def _(spark, d):
    """The fused products with cells summed along their longest fibres first."""
    t = fx.order4(spark, d)
    return _round_except(al.mttkrp_fibres(t, _factors(spark, t), RANK, 0), 4, "idx")


def _register_joins(name: str, target: int) -> None:
    """The fused products with every way joined by shuffle, and with salts on frequent indices."""

    @query(name, sql.completed_oracle("line3", 0, RANK))
    def _(spark, d):
        t = fx.line3(spark, d)
        factors = _factors(spark, t)
        plan = plan_joins(t.cells, t.dims, RANK, budget=0, target=target)
        done = al.complete(factors[0].select("idx"), al.mttkrp(t, factors, RANK, 0, plan=plan))
        return _round_except(done, 4, "idx")


_register_joins("mttkrp_shuffled", 1 << 40)
_register_joins("mttkrp_salted", 20)


@query(
    "matrix_norm",
    f"select round(sqrt(sum(x * x + y * y)), 4) as norm from ({sql.LINE3_PAIR})",
)
def _(spark, d):
    return _round_except(al.frobenius_norm(fx.line3_pair(spark, d), ["x", "y"]), 4)


def _derived(spark, t: PairedTensor, rank: int = RANK) -> list[DataFrame]:
    """Factors that come from the data: the two plain products of every way."""
    start = _factors(spark, t, rank)
    t = t.with_cells(cut_lineage(t.cells))  # one pass per way
    out = []
    for w in range(t.ways):
        done = al.complete(start[w].select("idx"), al.mttkrp(t, start, rank, w, al.FUSED_TERMS[:2]))
        out.append(cut_lineage(done.toDF(*factor_columns(rank))))  # used several times
    return out


def _unit(spark, t: PairedTensor) -> list[DataFrame]:
    names = factor_columns(RANK)[1:]
    return [al.normalize_columns(f, names) for f in _derived(spark, t)]


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query("gram", sql.gram_oracle("order4", RANK))
def _(spark, d):
    grams = [
        al.unit_gram_long(f, RANK).select(F.lit(w).alias("way"), "side", "p", "q", "g")
        for w, f in enumerate(_derived(spark, fx.order4(spark, d)))
    ]
    return _rounded(_union(grams), 6, ["g"])


@query("gram_hadamard", sql.hadamard_oracle("order4", RANK))
def _(spark, d):
    return _rounded(al.gram_hadamard(_unit(spark, fx.order4(spark, d)), RANK, "x"), 6, ["g"])


def _register_norms(name: str, by_norm: str) -> None:
    @query(name, sql.norms_oracle("event3", RANK, by_norm == "1"))
    def _(spark, d):
        names = factor_columns(RANK)[1:]
        rows = [
            al.column_norms(f, names, by_norm).withColumn("way", F.lit(w))
            for w, f in enumerate(_derived(spark, fx.event3(spark, d)))
        ]
        return _round_except(_union(rows), 3, "way")


_register_norms("column_norms", "2")
_register_norms("column_sums", "1")


@query("normalize_columns", sql.normalized_oracle("line3", RANK))
def _(spark, d):
    t = fx.line3(spark, d)
    start = _factors(spark, t)
    done = al.complete(start[0].select("idx"), al.mttkrp(t, start, RANK, 0, al.FUSED_TERMS[:2]))
    factor = done.toDF(*factor_columns(RANK))
    return _round_except(al.normalize_columns(factor, factor_columns(RANK)[1:]), 8, "idx")


@query("component_tail", sql.tail_oracle("event3", RANK, 2))
def _(spark, d):
    factor = _derived(spark, fx.event3(spark, d))[0]
    tails = factor.selectExpr("idx", *[f"{al.tail_mass(RANK, s, 2)} AS tail_{s}" for s in ("x", "y")])
    return _round_except(tails, 3, "idx")


@query("inner_product", sql.inner_oracle("order4", RANK))
def _(spark, d):
    t = fx.order4(spark, d)
    return _round_except(al.inner_products(t, _factors(spark, t), RANK), 3)


@query("joint_cost", sql.joint_cost_oracle("event3", RANK))
def _(spark, d):
    t = fx.event3(spark, d)
    row = al.joint_cost_table(t, _factors(spark, t), RANK)
    return _rounded(_rounded(row, 6, ["cost"]), 4, ["norm_x", "norm_y"])


@query("core_diag", sql.core_diag_oracle("order4", RANK))
def _(spark, d):
    t = fx.order4(spark, d)
    return _round_except(al.core_long(al.core_diagonal(t, _factors(spark, t), RANK), RANK), 4, "r")


@query("core_full", sql.core_full_oracle("event3", RANK))
def _(spark, d):
    t = fx.event3(spark, d)
    return _round_except(al.core_full(t, _factors(spark, t), RANK), 4, "r0", "r1", "r2")


@query("core_full_4way", sql.core_full_oracle("order4", 3))
def _(spark, d):
    t = fx.order4(spark, d)
    return _round_except(al.core_full(t, _factors(spark, t, 3), 3), 4, "r0", "r1", "r2", "r3")


@query("reconstruct", sql.reconstruct_oracle("order4", RANK))
def _(spark, d):
    t = fx.order4(spark, d)
    scored = al.reconstruct(t, _factors(spark, t), RANK)
    return _rounded(scored, 6, ["pred_x", "pred_y"]).select(*t.coords, "x", "y", "pred_x", "pred_y")


@query("holdout_rmse", sql.holdout_oracle("order4", RANK, TENTHS))
def _(spark, d):
    t = fx.order4(spark, d)
    labelled = t.with_cells(with_split(t.cells, t.coords, TENTHS))
    out = holdout_rmse(labelled, _factors(spark, t), RANK)
    return _rounded(out, 6, ["rmse_x", "rmse_y"])


# --- weights ---------------------------------------------------------------

def _raw_weights(spark, d) -> DataFrame:
    """Core sums of the grown and shrunk signals, read as component weights."""
    t = fx.event3(spark, d)
    core = al.core_long(al.core_diagonal(t, _factors(spark, t), RANK), RANK)
    return core.selectExpr(
        "inline(array(named_struct('side', 'x', 'r', r, 'w', gzx), "
        "named_struct('side', 'y', 'r', r, 'w', gzy)))"
    )


@query("weights_normalize", sql.weights_oracle("event3", RANK))
def _(spark, d):
    return _rounded(normalize_weights(_raw_weights(spark, d)), 8, ["w"])


@query("weights_wide", sql.weights_wide_oracle("event3", RANK))
def _(spark, d):
    wide = widen_weights(normalize_weights(_raw_weights(spark, d)), RANK)
    rounded = _rounded(wide, 8, [f"w{r}" for r in range(RANK)])
    return tag(rounded, trial_ID=0, alpha=0.1, k="event")


# --- solver steps and fits -------------------------------------------------

def _prepared(spark, d, cfg: FitConfig) -> tuple[Workspace, FitState]:
    t = fx.event3(spark, d)
    return Workspace.prepare(t, cfg), start_state(t, [cfg])


def _fit_config(**changes) -> FitConfig:
    return FitConfig(rank=FIT_RANK, max_iter=FIT_ITERATIONS, seed=fx.SEED, **changes)


BASELINE = {"alpha": 1e-4, "beta": 1e-4, "distance": FIT_COMMON}


@query("pairwise_way_step", sql.way_step_oracle("event3", FIT_RANK))
def _(spark, d):
    cfg = _fit_config()
    ws, state = _prepared(spark, d, cfg)
    update_way(ws, state, 0)
    return _round_except(state.factors[0], 7, "idx")


@query("weight_step", sql.weight_step_oracle("event3", FIT_RANK))
def _(spark, d):
    cfg = _fit_config()
    ws, state = _prepared(spark, d, cfg)
    run = pairwise(ws, state).runs[0]
    rows = [
        (s, r, float(w[r]), float(z[r]))
        for s, w, z in (("x", run.wx, run.zwx), ("y", run.wy, run.zwy))
        for r in range(FIT_RANK)
    ]
    return _rounded(
        spark.createDataFrame(rows, "side STRING, r INT, w DOUBLE, z DOUBLE"), 7, ["w", "z"]
    )


@query("baseline_step", sql.baseline_step_oracle("event3", FIT_RANK, FIT_COMMON))
def _(spark, d):
    cfg = _fit_config(**BASELINE)
    ws, state = _prepared(spark, d, cfg)
    baseline(ws, state)
    steps = [
        f.select(F.lit(w).alias("way"), *factor_columns(FIT_RANK))
        for w, f in enumerate(state.factors)
    ]
    return _round_except(_union(steps), 5, "way", "idx")


def _fit_rows(spark: SparkSession, result) -> DataFrame:
    """Costs, weights and every factor entry as one long table."""
    long = "item STRING, idx INT, r INT, value DOUBLE"
    scalars = [("cost", it, 0, round(cost, 7)) for it, _e, cost, _d in result.log]
    for s, w in (("x", result.weights_x), ("y", result.weights_y)):
        scalars += [(f"weight_{s}", 0, r, round(float(v), 7)) for r, v in enumerate(w)]
    tables = [spark.createDataFrame(scalars, long)]
    for k, factor in enumerate(result.factors):
        digits = 4 if k == len(result.factors) - 1 else 7
        entries = ", ".join(
            f"named_struct('item', 'factor{k}_{s}', 'idx', idx, 'r', {r}, "
            f"'value', round({s}{r}, {digits}) + 0.0D)"
            for s in ("x", "y")
            for r in range(result.config.rank)
        )
        tables.append(factor.selectExpr(f"inline(array({entries}))"))
    return _union(tables)


@query("pairwise_fit", sql.pairwise_oracle("event3", FIT_RANK, FIT_ITERATIONS))
def _(spark, d):
    return _fit_rows(spark, fit(fx.event3(spark, d), pairwise, _fit_config()))


@query("pairwise_momentum", sql.pairwise_oracle("event3", FIT_RANK, 4, ahead=True))
def _(spark, d):
    """Factor momentum: the first push acts in the third of four iterations."""
    cfg = replace(_fit_config(factor_momentum=True), max_iter=4)
    return _fit_rows(spark, fit(fx.event3(spark, d), pairwise, cfg))


@query("baseline_fit", sql.baseline_oracle("event3", FIT_RANK, FIT_COMMON, FIT_ITERATIONS))
def _(spark, d):
    return _fit_rows(spark, fit(fx.event3(spark, d), baseline, _fit_config(**BASELINE)))


# --- run management --------------------------------------------------------

#: (seed, tolerance) of runs that are fitted together and stop on their own.
STOPS = [(1, 0.02), (1, 1e-9), (2, 0.02), (2, 0.001), (3, 0.05), (3, 1e-9)]


@query("stop_rule", sql.stop_oracle("event3", 2, STOPS, 3))
def _(spark, d):
    """Iterations and final cost of six runs in one batch, each with a tolerance of its own."""
    cfgs = [FitConfig(rank=2, max_iter=3, seed=s, tolerance=t) for s, t in STOPS]
    results = fit_runs(fx.event3(spark, d), pairwise, cfgs)
    rows = [(s, t, len(r.log), round(r.cost, 7)) for (s, t), r in zip(STOPS, results)]
    return spark.createDataFrame(rows, "seed INT, tolerance DOUBLE, iterations INT, cost DOUBLE")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """One run per market segment (as case study), sampling month and parameter pair."""
    months = fx.table(spark, d, "orders").select(F.month("o_orderdate").alias("seed")).distinct()
    cases = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("k")).distinct()
    alphas, betas = "explode(array(0.1D, 0.01D)) AS alpha", "explode(array(1.0D, 2.0D)) AS beta"
    return (
        cases.selectExpr("k", alphas).selectExpr("*", betas).join(F.broadcast(months), F.lit(True))
    )


GRID_SQL = """
select k, alpha, beta, seed from (select distinct c_mktsegment as k from customer),
  (select unnest([cast(0.1 as double), cast(0.01 as double)]) as alpha),
  (select unnest([cast(1.0 as double), cast(2.0 as double)]) as beta),
  (select distinct cast(extract(month from o_orderdate) as int) as seed from orders)
"""


@query("run_grid", GRID_SQL)
def _(spark, d):
    return _grid(spark, d)


@query(
    "parameter_grid",
    "select seed, method, rank, alpha from (select distinct cast(extract(month from o_orderdate) as int) "
    "as seed from orders), (select unnest(['baseline', 'pairwise']) as method), (select unnest([4, 6]) as "
    "rank), (select unnest([cast(0.1 as double), cast(1 as double)]) as alpha)",
)
def _(spark, d):
    """The grid of a sweep over the sampling months that the orders have."""
    months = fx.table(spark, d, "orders").select(F.month("o_orderdate").alias("m")).distinct()
    seeds = sorted(r.m for r in months.collect())  # twelve at most
    return run_grid(spark, seed=seeds, method=["baseline", "pairwise"], rank=[4, 6], alpha=[0.1, 1.0])


@query(
    "pending_runs",
    f"select g.* from ({GRID_SQL}) g where not exists (select 1 from (select c_mktsegment as k, "
    "cast(extract(month from o_orderdate) as int) as seed, sum(o_totalprice) as total from orders "
    "join customer on o_custkey = c_custkey group by 1, 2) t where t.k = g.k and t.seed = g.seed "
    "and t.total >= (select sum(o_totalprice) / 60 from orders))",
)
def _(spark, d):
    """Runs left when the (case, sample) pairs with an above-average total are done."""
    orders = fx.table(spark, d, "orders")
    totals = (
        orders.join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("k"), F.month("o_orderdate").alias("seed"))
        .agg(F.sum("o_totalprice").alias("total"))
    )
    mean = orders.agg((F.sum("o_totalprice") / 60).alias("mean"))
    done = totals.join(F.broadcast(mean)).where("total >= mean").select("k", "seed")
    return pending_runs(_grid(spark, d), done, ["k", "seed"])


@query(
    "cost_delta",
    "select run, iter, round(cost, 6) as cost, round(abs(cost - lag(cost) over (partition by run "
    "order by iter)), 6) as delta from (select event_type as run, cast(extract(day from ts) as int) "
    "as iter, avg(value) as cost from events group by 1, 2)",
)
def _(spark, d):
    log = (
        fx.table(spark, d, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("iter"))
        .agg(F.avg("value").alias("cost"))
    )
    return _rounded(cost_delta(log, ["run"]), 6, ["cost", "delta"])


@query("run_sweep", sql.sweep_oracle("event3", 2, 1, 2))
def _(spark, d):
    """Two methods, two trials each, on the event pair; resumes from its own output."""
    out = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid.uuid4().hex}"
    runs = [
        (m, 0, 2, 1, a, b, 0.1, 1e-8, 10.0)
        for m, a, b in (("pairwise", 0.1, 0.1), ("baseline", 1e-4, 1e-4))
    ]
    grid = spark.createDataFrame(
        runs,
        "method STRING, seed INT, rank INT, distance INT, alpha DOUBLE, beta DOUBLE, "
        "gamma DOUBLE, delta DOUBLE, train_proportion DOUBLE",
    )
    costs = run_sweep(
        spark, lambda seed: fx.event3(spark, d), grid.select(*RUN_KEYS), out, trials=2, max_iter=1
    )
    return _rounded(costs, 7, ["cost"])


def _settings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A grid of (method, rank, alpha, beta) over one sample, gamma 0.1, one common column."""
    full = [(m, 0, r, 1, a, b, 0.1, 1e-8, 10.0) for m, r, a, b in rows]
    return spark.createDataFrame(full, RUN_KEY_SCHEMA)


#: Settings of several ranks and parameters that are fitted over one layout of the cells.
SETTINGS = [
    ("pairwise", 2, 0.1, 0.1), ("pairwise", 3, 0.1, 0.1), ("pairwise", 2, 0.5, 0.2), ("baseline", 2, 1e-4, 1e-4),
    ("baseline", 3, 1e-3, 1e-4),
]


@query("sweep_settings", sql.settings_oracle("event3", SETTINGS, 1, 2))
def _(spark, d):
    """Final costs of several settings and ranks, two trials each, over cells loaded once."""
    out = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid.uuid4().hex}"
    loads = []

    def load(seed):
        if loads:
            raise ValueError("the cells of a sample are loaded once")
        loads.append(seed)
        return fx.event3(spark, d)

    costs = run_sweep(spark, load, _settings(spark, SETTINGS), out, trials=2, max_iter=1)
    return _rounded(costs.select("method", "rank", "alpha", "beta", "trial_ID", "cost"), 7, ["cost"])


def _interrupted(spark: SparkSession, d: str, fmt: str = "parquet") -> str:
    """A sweep broken off after two of five settings and called again; the folder of its output.

    One of the two has written its weights, logs and infos but not its cost rows.
    """
    out = f"{ensure_checkpoint_dir(spark)}/sweep-{uuid.uuid4().hex}"
    load = lambda seed: fx.event3(spark, d)
    grid = _settings(spark, SETTINGS)
    first = run_sweep(spark, load, _settings(spark, SETTINGS[:2]), out, trials=2, max_iter=2, fmt=fmt)
    lost = first.where("rank = 3").select(*RUN_KEYS).distinct().collect()
    remove_path(spark, f"{out}/cost_final/run={run_name(lost[0].asDict())}")
    run_sweep(spark, load, grid, out, trials=2, max_iter=2, fmt=fmt)
    return out


@query("resume_sweep", sql.resumed_oracle("event3", SETTINGS, 2, 2))
def _(spark, d):
    """Logged costs of a sweep that was broken off between its sinks and repeated: every row once."""
    out = _interrupted(spark, d)
    log = committed(spark, spark.read.parquet(f"{out}/run_log"), out)
    counted = log.groupBy("method", "rank", "alpha", "beta", "trial_ID", "iter").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("cost").alias("cost")
    )
    return _rounded(counted, 7, ["cost"])


@query("sweep_weights", sql.sweep_weights_oracle("event3", SETTINGS, 2, 2, 3))
def _(spark, d):
    """Weight rows of the rank-3 settings of the same sweep, read back from its CSV sink."""
    out = _interrupted(spark, d, "csv")
    weights = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/weights_R3")
    kept = committed(spark, weights, out, "csv")
    names = [f"w{r}" for r in range(3)]
    return _rounded(kept.select("method", "alpha", "beta", "trial_ID", "tensor", *names), 7, names)


@query("warm_restart", sql.pairwise_oracle("event3", FIT_RANK, 3))
def _(spark, d):
    """A fit broken off in its third iteration goes on after its second one."""
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    tensor, cfg = fx.event3(spark, d), replace(_fit_config(), max_iter=3)

    class BrokenOff(Exception):
        pass

    def broken(i, _state):
        if i == 3:
            raise BrokenOff

    try:
        fit(tensor, pairwise, cfg, on_iteration=broken, state_path=path)
    except BrokenOff:
        pass
    seen = []
    result = fit(tensor, pairwise, cfg, on_iteration=lambda i, _s: seen.append(i), state_path=path)
    if seen != [3]:
        raise ValueError(f"iterations {seen} were run after the restart")
    return _fit_rows(spark, result)


@query("factor_sink", sql.pairwise_oracle("event3", FIT_RANK, FIT_ITERATIONS))
def _(spark, d):
    """A fit from start factors that were written by the factor sink and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/factors-{uuid.uuid4().hex}"
    tensor = fx.event3(spark, d)
    for way, factor in enumerate(_factors(spark, tensor, FIT_RANK)):
        write_matrix(factor, FIT_RANK, way, path, run="start", trial=0)
    start = read_factors(spark, path, FIT_RANK, tensor.ways, run="start", trial=0)
    return _fit_rows(spark, fit(tensor, pairwise, _fit_config(), init=start))


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _o) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: o for name, (_f, o) in REGISTRY.items() if o is not None}
