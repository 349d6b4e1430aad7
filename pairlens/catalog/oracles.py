"""DuckDB SQL giving the same results as the registered queries, on the same tables.

Written independently of the Spark code: group-bys, joins and chained CTEs over the given
tables, with the start-value and split formulas spelled out in plain SQL.
"""

from __future__ import annotations

ORDER4_PAIR = """
select cast(c_nationkey as int) as i0, cast(substr(p_brand, 7) as int) - 1 as i1,
  case p_type when 'ECONOMY' then 0 when 'SMALL' then 1 when 'STANDARD' then 2
              when 'PROMO' then 3 when 'MEDIUM' then 4 else 5 end as i2,
  cast(substr(o_orderpriority, 1, 1) as int) - 1 as i3,
  sum(case when l_returnflag = 'R' then l_quantity else 0 end) as x,
  sum(case when l_returnflag = 'A' then l_quantity else 0 end) as y
from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
where l_returnflag in ('R', 'A') group by 1, 2, 3, 4
"""

EVENT3_PAIR = """
select cast(user_id % 16 as int) as i0,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2
                  when 'signup' then 3 else 4 end as i1,
  cast(extract(hour from ts) as int) as i2,
  cast(sum(case when ts <  timestamp '2024-01-16' then 1 else 0 end) as double) as x,
  cast(sum(case when ts >= timestamp '2024-01-16' then 1 else 0 end) as double) as y
from events group by 1, 2, 3
"""

LINE3_PAIR = """
select cast(o_custkey as int) as i0, cast(l_partkey as int) as i1, cast(l_suppkey as int) as i2,
  sum(case when l_returnflag = 'R' then l_quantity else 0 end) as x,
  sum(case when l_returnflag = 'A' then l_quantity else 0 end) as y
from lineitem join orders on l_orderkey = o_orderkey
where l_returnflag in ('R', 'A') group by 1, 2, 3
"""

PAIRS = {"order4": ORDER4_PAIR, "event3": EVENT3_PAIR, "line3": LINE3_PAIR}
WAYS = {"order4": 4, "event3": 3, "line3": 3}
DIMS = {
    "order4": ("25", "25", "6", "5"),
    "event3": ("16", "5", "24"),
    "line3": (
        "(select count(*) from customer)",
        "(select count(*) from part)",
        "(select count(*) from supplier)",
    ),
}
FUSED = (("mx", "x", "x"), ("my", "y", "y"), ("mzx", "zx", "x"), ("mzy", "zy", "y"),
         ("msx", "s", "x"), ("msy", "s", "y"))
CORE = (("gzx", "zx", "x"), ("gzy", "zy", "y"), ("gsx", "s", "x"), ("gsy", "s", "y"))


def coords(fixture: str, prefix: str = "") -> str:
    return ", ".join(f"{prefix}i{w}" for w in range(WAYS[fixture]))


def signals_sql(fixture: str, source: str) -> str:
    return f"""select {coords(fixture)}, x, y,
  case when x - y > 0 then x - y else 0.0::double end as zx,
  case when y - x > 0 then y - x else 0.0::double end as zy,
  cast(case when abs(x - y) <= cast(1e-5 as double) then 1 else 0 end as int) as s
from {source}"""


P, Q = 2147483647, 2147483629


def formula(i: str, way: int, r: int, side: str, seed: int) -> str:
    base = (seed + 1) * 1000003 + (way + 1) * 7919 + (r + 1) * 104729 + (side == "y") * 15485863
    m = [((base + k * 179424673) % P) ** 2 % P * 48271 % P + 1 for k in range(1, 6)]
    i = f"(cast({i} as bigint) + 1)"
    h = f"(({i} % {P} * {m[0]} + {i} % {Q} * {m[1]} + {m[2]}) % {P})"
    return f"(cast(({h} * {h} % {P} * {m[3]} + {h} * {m[4]}) % {P} as double) / cast({P} as double))"


def factor_cte(fixture: str, way: int, rank: int, seed: int) -> str:
    values = ", ".join(
        f"{formula('i', way, r, s, seed)} as {s}{r}" for s in ("x", "y") for r in range(rank)
    )
    dim = DIMS[fixture][way]
    return (
        f"f{way} as materialized (select cast(i as int) as idx, {values} from "
        f"(select unnest(range({dim})) as i))"
    )


def base_ctes(fixture: str, rank: int, seed: int = 1) -> list[str]:
    return [
        f"pair as materialized ({PAIRS[fixture]})",
        f"cells as materialized ({signals_sql(fixture, 'pair')})",
        *[factor_cte(fixture, w, rank, seed) for w in range(WAYS[fixture])],
    ]


def with_(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


def product(ways, side: str, r: int, name="f{w}") -> str:
    return " * ".join(f"{name.format(w=w)}.{side}{r}" for w in ways)


def joins(ways, name="f{w}") -> str:
    return " ".join(
        f"join {name.format(w=w)} on c.i{w} = {name.format(w=w)}.idx" for w in ways
    )


def mttkrp_sql(n: int, way: int, rank: int, terms=FUSED, name="f{w}") -> str:
    over = [w for w in range(n) if w != way]
    sums = ", ".join(
        f"sum(c.{v} * {product(over, side, r, name)}) as {p}{r}"
        for p, v, side in terms for r in range(rank)
    )
    return f"select c.i{way} as idx, {sums} from cells c {joins(over, name)} group by 1"


def rounded(names, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


def term_names(terms, rank: int) -> list[str]:
    return [f"{p}{r}" for p, _, _ in terms for r in range(rank)]


def mttkrp_oracle(fixture: str, way: int, rank: int, terms=FUSED) -> str:
    n = WAYS[fixture]
    return with_(
        base_ctes(fixture, rank) + [f"m as ({mttkrp_sql(n, way, rank, terms)})"],
        f"select idx, {rounded(term_names(terms, rank))} from m",
    )


def completed_oracle(fixture: str, way: int, rank: int) -> str:
    n = WAYS[fixture]
    names = term_names(FUSED, rank)
    filled = ", ".join(f"round(coalesce({c}, 0.0), 4) + 0.0 as {c}" for c in names)
    return with_(
        base_ctes(fixture, rank) + [f"m as ({mttkrp_sql(n, way, rank)})"],
        f"select f{way}.idx as idx, {filled} from f{way} left join m on f{way}.idx = m.idx",
    )


def derived_ctes(fixture: str, rank: int) -> list[str]:
    """Factors taken from the data: the two plain products of every way, completed."""
    n = WAYS[fixture]
    out = base_ctes(fixture, rank)
    terms = FUSED[:2]
    for w in range(n):
        cols = ", ".join(
            f"coalesce(m.m{s}{r}, 0.0) as {s}{r}" for s in ("x", "y") for r in range(rank)
        )
        out.append(f"m{w} as materialized ({mttkrp_sql(n, w, rank, terms)})")
        out.append(
            f"d{w} as materialized (select f{w}.idx, {cols} from f{w} left join m{w} m on f{w}.idx = m.idx)"
        )
    return out


def scaled_ctes(fixture: str, rank: int) -> list[str]:
    """The data-derived factors with unit columns, so products stay in a sane range."""
    out = derived_ctes(fixture, rank)
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    for w in range(WAYS[fixture]):
        norms = ", ".join(f"sqrt(sum({c} * {c})) as n_{c}" for c in names)
        out.append(f"n{w} as materialized (select {norms} from d{w})")
        cols = ", ".join(f"case when n_{c} > 0 then {c} / n_{c} else {c} end as {c}" for c in names)
        out.append(f"u{w} as materialized (select idx, {cols} from d{w}, n{w})")
    return out


def gram_oracle(fixture: str, rank: int) -> str:
    parts = [
        f"select {w} as way, '{s}' as side, {p} as p, {q} as q,"
        f" round(sum({s}{p} * {s}{q}), 6) as g from u{w}"
        for w in range(WAYS[fixture]) for s in ("x", "y")
        for p in range(rank) for q in range(rank)
    ]
    return with_(scaled_ctes(fixture, rank), " union all ".join(parts))


def hadamard_oracle(fixture: str, rank: int) -> str:
    ctes = scaled_ctes(fixture, rank)
    for w in range(WAYS[fixture]):
        rows = " union all ".join(
            f"select {p} as p, {q} as q, sum(x{p} * x{q}) as g from u{w}"
            for p in range(rank) for q in range(rank)
        )
        ctes.append(f"g{w} as materialized ({rows})")
    joined = " ".join(f"join g{w} using (p, q)" for w in range(1, WAYS[fixture]))
    value = " * ".join(f"g{w}.g" for w in range(WAYS[fixture]))
    return with_(ctes, f"select p, q, round({value}, 6) as g from g0 {joined}")


def norms_oracle(fixture: str, rank: int, l1: bool) -> str:
    form = "sum({0})" if l1 else "sqrt(sum({0} * {0}))"
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    parts = [
        f"select {w} as way, " + ", ".join(f"round({form.format(c)}, 3) as n_{c}" for c in names)
        + f" from d{w}"
        for w in range(WAYS[fixture])
    ]
    return with_(derived_ctes(fixture, rank), " union all ".join(parts))


def normalized_oracle(fixture: str, rank: int) -> str:
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    return with_(
        scaled_ctes(fixture, rank), f"select idx, {rounded(names, 8)} from u0"
    )


def tail_oracle(fixture: str, rank: int, k: int) -> str:
    def tail(s):
        return " + ".join(f"{s}{r}" for r in range(k, rank))

    return with_(
        derived_ctes(fixture, rank),
        f"select idx, round({tail('x')}, 3) as tail_x, round({tail('y')}, 3) as tail_y from d0",
    )


def inner_oracle(fixture: str, rank: int) -> str:
    n = range(WAYS[fixture])
    model = {s: " + ".join(product(n, s, r) for r in range(rank)) for s in ("x", "y")}
    return with_(
        base_ctes(fixture, rank),
        "select " + ", ".join(f"round(sum(c.{s} * ({model[s]})), 3) as inner_{s}" for s in ("x", "y"))
        + f" from cells c {joins(n)}",
    )


def model_norm_sql(n: int, rank: int, side: str, name: str) -> str:
    """Sum over (p, q) of the product of Gram entries, from single-row Gram tables."""
    return " + ".join(
        "(" + " * ".join(f"{name.format(w=w)}.{side}_{p}_{q}" for w in range(n)) + ")"
        for p in range(rank) for q in range(rank)
    )


def gram_row_sql(factor: str, rank: int) -> str:
    cols = ", ".join(
        f"sum({s}{p} * {s}{q}) as {s}_{p}_{q}"
        for s in ("x", "y") for p in range(rank) for q in range(rank)
    )
    cross = ", ".join(f"sum(x{r} * y{r}) as cross_{r}" for r in range(rank))
    return f"select {cols}, {cross} from {factor}"


def cost_sql(n: int, rank: int, inner: str, norms: str, grams: str) -> str:
    part = {
        s: f"sqrt(greatest(n{s} * n{s} + ({model_norm_sql(n, rank, s, grams)}) - 2 * in{s}, 0.0)) / n{s}"
        for s in ("x", "y")
    }
    tables = ", ".join([inner, norms] + [grams.format(w=w) for w in range(n)])
    return f"({part['x']} + {part['y']}) / 2 as cost from {tables}"


def inner_row_sql(n: int, rank: int, name: str) -> str:
    model = {s: " + ".join(product(range(n), s, r, name) for r in range(rank)) for s in ("x", "y")}
    return (
        f"select sum(c.x * ({model['x']})) as inx, sum(c.y * ({model['y']})) as iny "
        f"from cells c {joins(range(n), name)}"
    )


NORMS_ROW = "select sqrt(sum(x * x)) as nx, sqrt(sum(y * y)) as ny from cells"


def joint_cost_oracle(fixture: str, rank: int) -> str:
    n = WAYS[fixture]
    ctes = base_ctes(fixture, rank)
    ctes += [f"g{w} as materialized ({gram_row_sql(f'f{w}', rank)})" for w in range(n)]
    ctes += [f"nrm as ({NORMS_ROW})", f"inn as ({inner_row_sql(n, rank, 'f{w}')})"]
    ctes.append(f"c as (select nx, ny, {cost_sql(n, rank, 'inn', 'nrm', 'g{w}')})")
    return with_(ctes, "select round(nx, 4) as norm_x, round(ny, 4) as norm_y, round(cost, 6) as cost from c")


def core_diag_oracle(fixture: str, rank: int) -> str:
    n = range(WAYS[fixture])
    parts = [
        f"select {r} as r, "
        + ", ".join(f"round(sum(c.{v} * {product(n, s, r)}), 4) + 0.0 as {p}" for p, v, s in CORE)
        + f" from cells c {joins(n)}"
        for r in range(rank)
    ]
    return with_(base_ctes(fixture, rank), " union all ".join(parts))


def core_full_oracle(fixture: str, rank: int) -> str:
    n = WAYS[fixture]
    ctes = base_ctes(fixture, rank)
    for w in range(n):
        rows = " union all ".join(
            f"select idx, {r} as r{w}, x{r} as x, y{r} as y from f{w}" for r in range(rank)
        )
        ctes.append(f"l{w} as materialized ({rows})")
    sums = ", ".join(
        f"round(sum(c.{v} * " + " * ".join(f"l{w}.{s}" for w in range(n)) + f"), 4) + 0.0 as {p}"
        for p, v, s in CORE
    )
    keys = ", ".join(f"r{w}" for w in range(n))
    on = " ".join(f"join l{w} on c.i{w} = l{w}.idx" for w in range(n))
    return with_(ctes, f"select {keys}, {sums} from cells c {on} group by {keys}")


def reconstruct_oracle(fixture: str, rank: int) -> str:
    n = range(WAYS[fixture])
    preds = ", ".join(
        f"round({' + '.join(product(n, s, r) for r in range(rank))}, 6) as pred_{s}"
        for s in ("x", "y")
    )
    return with_(
        base_ctes(fixture, rank),
        f"select {coords(fixture, 'c.')}, c.x, c.y, {preds} from cells c {joins(n)}",
    )


def bucket_sql(ways: int, seed: int = 2) -> str:
    h = f"cast({seed} as bigint)"
    for w in range(ways):
        i = f"(cast(i{w} as bigint) + 1)"
        h = f"(({h} * 48271 + {i} % {P} * 69621 + 15485) % {P})"
        h = f"(({h} * {h} % {P} * 16807 + {i} % {Q} * 39373) % {P})"
    return h


def split_sql(ways: int, tenths: float) -> str:
    test_end = repr((10.0 - tenths) / 2.0 / 10.0 * P)
    both = repr(2 * ((10.0 - tenths) / 2.0 / 10.0 * P))
    b = bucket_sql(ways)
    return (
        f"case when {b} < cast({test_end} as double) then 'test' "
        f"when {b} < cast({both} as double) then 'validation' else 'train' end"
    )


def split_oracle(fixture: str, tenths: float) -> str:
    return (
        f"select {coords(fixture)}, {split_sql(WAYS[fixture], tenths)} as split "
        f"from ({PAIRS[fixture]})"
    )


def train_subset_oracle(fixture: str, tenths: float) -> str:
    return (
        f"select {coords(fixture)}, x, y from ({PAIRS[fixture]}) "
        f"where {split_sql(WAYS[fixture], tenths)} = 'train'"
    )


def holdout_oracle(fixture: str, rank: int, tenths: float) -> str:
    n = range(WAYS[fixture])
    pred = {s: " + ".join(product(n, s, r) for r in range(rank)) for s in ("x", "y")}
    ctes = base_ctes(fixture, rank)
    ctes.append(
        f"scored as (select {split_sql(WAYS[fixture], tenths)} as split, c.x - ({pred['x']}) as ex, "
        f"c.y - ({pred['y']}) as ey from cells c {joins(n)})"
    )
    return with_(
        ctes,
        "select split, round(sqrt(avg(ex * ex)), 6) as rmse_x, round(sqrt(avg(ey * ey)), 6) as rmse_y, "
        "count(*) as n_cells from scored where split <> 'train' group by split",
    )


def topn_ctes(fixture: str, n: int) -> list[str]:
    c = coords(fixture)
    return [
        f"pair as materialized ({PAIRS[fixture]})",
        *[
            f"t{s} as (select {c} from (select {c}, row_number() over (order by {s} desc, {c}) as rn "
            f"from pair where {s} > 0) where rn <= {n})"
            for s in ("x", "y")
        ],
        f"cand as (select {c} from tx union select {c} from ty)",
    ]


def candidates_oracle(fixture: str, n: int) -> str:
    return with_(topn_ctes(fixture, n), f"select {coords(fixture)} from cand")


def paired_topn_oracle(fixture: str, n: int) -> str:
    c = coords(fixture)
    ctes = topn_ctes(fixture, n)
    ctes.append(
        f"al as (select {c}, coalesce(px.x, 0.0) as x, coalesce(py.y, 0.0) as y from cand "
        f"left join (select {c}, x from pair where x > 0) px using ({c}) "
        f"left join (select {c}, y from pair where y > 0) py using ({c}))"
    )
    return with_(ctes, signals_sql(fixture, "al"))


def weights_ctes(fixture: str, rank: int) -> list[str]:
    n = range(WAYS[fixture])
    ctes = base_ctes(fixture, rank)
    rows = " union all ".join(
        f"select '{s}' as side, {r} as r, sum(c.z{s} * {product(n, s, r)}) as w from cells c {joins(n)}"
        for s in ("x", "y") for r in range(rank)
    )
    ctes.append(f"raw as materialized ({rows})")
    ctes.append("wn as (select side, r, w / sum(w) over (partition by side) as w from raw)")
    return ctes


def weights_oracle(fixture: str, rank: int) -> str:
    return with_(weights_ctes(fixture, rank), "select side, r, round(w, 8) as w from wn")


def weights_wide_oracle(fixture: str, rank: int) -> str:
    cols = ", ".join(f"round(max(case when r = {r} then w end), 8) as w{r}" for r in range(rank))
    return with_(
        weights_ctes(fixture, rank),
        f"select {cols}, upper(side) as tensor, 0 as \"trial_ID\", cast(0.1 as double) as alpha, "
        "'event' as k from wn group by side",
    )


# --- whole fits as chained CTEs --------------------------------------------

def start_ctes(fixture: str, rank: int, seed: int = 1) -> list[str]:
    """Cells, norms and column-normalised start factors a{w} with their Gram rows."""
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    out = base_ctes(fixture, rank, seed)
    out.append(f"nrm as materialized ({NORMS_ROW})")
    for w in range(WAYS[fixture]):
        norms = ", ".join(f"sqrt(sum({c} * {c})) as n_{c}" for c in names)
        cols = ", ".join(f"case when n_{c} > 0 then {c} / n_{c} else {c} end as {c}" for c in names)
        out.append(f"a0_{w} as materialized (select idx, {cols} from f{w}, (select {norms} from f{w}))")
        out.append(f"g0_{w} as materialized ({gram_row_sql(f'a0_{w}', rank)})")
    return out


def _gram_product(ways, rank: int, version) -> str:
    """Single row fx_p_q, fy_p_q and their Frobenius norms."""
    cols = ", ".join(
        " * ".join(f"{version(w)}.{s}_{p}_{q}" for w in ways) + f" as f{s}_{p}_{q}"
        for s in ("x", "y") for p in range(rank) for q in range(rank)
    )
    norm = ", ".join(
        "sqrt(" + " + ".join(f"f{s}_{p}_{q} * f{s}_{p}_{q}" for p in range(rank) for q in range(rank))
        + f") as nf{s}"
        for s in ("x", "y")
    )
    return f"select *, {norm} from (select {cols} from {', '.join(version(w) for w in ways)})"


def _others(columns: list[str], new: dict[str, str]) -> str:
    return ", ".join(f"{new[c]} as {c}" if c in new else c for c in columns)


def pairwise_ctes(
    fixture: str, rank: int, iterations: int, lam=(0.1, 0.1, 0.1), eps=1e-16, seed: int = 1,
    ahead: bool = False,
):
    """All tables of a pairwise fit; returns (ctes, factor version per way, iterations).

    With ``ahead`` (factor momentum) mo{it} holds the momentum and the push after iteration it, which
    a rise of the cost sets back.
    """
    n = WAYS[fixture]
    l1, l2, l3 = (f"cast({v!r} as double)" for v in lam)
    e = f"cast({eps!r} as double)"
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    ctes = start_ctes(fixture, rank, seed)
    w0 = ", ".join(
        f"cast({1.0 / rank!r} as double) as {c}{s}{r}"
        for c in ("w", "z") for s in ("x", "y") for r in range(rank)
    )
    ctes.append(f"wt0 as materialized (select {w0})")
    ver = {w: f"0_{w}" for w in range(n)}
    older = dict(ver)
    momentum = 1.0
    if ahead:
        ctes.append("mo0 as (select cast(1 as double) as a, cast(0 as double) as push)")
        ctes.append("cost0 as (select cast(1e10 as double) as cost)")
    for it in range(1, iterations + 1):
        wt = f"wt{it - 1}"
        for k in range(n):
            tag = f"{it}_{k}"
            over = [w for w in range(n) if w != k]
            ctes.append(
                f"ff{tag} as materialized ({_gram_product(over, rank, lambda w: f'g{ver[w]}')})"
            )
            fac = {w: f"a{ver[w]}" for w in range(n)}
            sums = ", ".join(
                f"sum(c.{v} * " + " * ".join(f"{fac[w]}.{side}{r}" for w in over) + f") as {p}{r}"
                for p, v, side in FUSED for r in range(rank)
            )
            on = " ".join(f"join {fac[w]} on c.i{w} = {fac[w]}.idx" for w in over)
            ctes.append(f"m{tag} as materialized (select c.i{k} as idx, {sums} from cells c {on} group by 1)")
            ms = term_names(FUSED, rank)
            filled = ", ".join(f"coalesce(m{tag}.{c}, 0.0) as {c}" for c in ms)
            cur = f"s{tag}_start"
            points = [f"{'a' if ahead else ''}{c}" for c in names]
            moved = "".join(f", a.{c} + push * (a.{c} - o.{c}) as a{c}" for c in names) if ahead else ""
            old = f" join a{older[k]} o on a.idx = o.idx, mo{it - 1}" if ahead else ""
            ctes.append(
                f"{cur} as materialized (select a.idx, {', '.join('a.' + c for c in names)}, {filled}{moved} "
                f"from {fac[k]} a left join m{tag} on a.idx = m{tag}.idx{old})"
            )
            cols = ["idx", *names, *ms, *(points if ahead else [])]
            base = dict(zip(names, points))
            for l in range(rank):
                p = " + ".join(f"x{j} * fx_{j}_{l}" for j in range(rank))
                q = " + ".join(f"y{j} * fy_{j}_{l}" for j in range(rank))
                d = f"((1 - wx{l}) * x{l} - (1 - wy{l}) * y{l})"
                new = {
                    f"x{l}": f"{base[f'x{l}']} - (({p}) - mx{l} + {l1} / nx * wx{l} * (wx{l} * ({p}) - mzx{l})"
                    f" + {l2} / nx * (1 - wx{l}) * ((1 - wx{l}) * ({p}) - msx{l})"
                    f" + {l3} / nx * {d} * (1 - wx{l})) / nfx",
                    f"y{l}": f"{base[f'y{l}']} - (({q}) - my{l} + {l1} / ny * wy{l} * (wy{l} * ({q}) - mzy{l})"
                    f" + {l2} / ny * (1 - wy{l}) * ((1 - wy{l}) * ({q}) - msy{l})"
                    f" - {l3} / ny * {d} * (1 - wy{l})) / nfy",
                }
                raw = f"s{tag}_{l}r"
                ctes.append(
                    f"{raw} as materialized (select {_others(cols, new)} from {cur}, ff{tag}, {wt}, nrm)"
                )
                cur = f"s{tag}_{l}"
                if k < n - 1:
                    unit = f"(select sqrt(sum(x{l} * x{l})) as ux, sqrt(sum(y{l} * y{l})) as uy from {raw})"
                    val = {s: f"(case when u{s} > 0 then {s}{l} / u{s} else {s}{l} end)" for s in ("x", "y")}
                    src = f"{raw}, {unit}"
                else:
                    val = {s: f"{s}{l}" for s in ("x", "y")}
                    src = raw
                new = {f"{s}{l}": f"case when {val[s]} < {e} then 0.0 else {val[s]} end" for s in ("x", "y")}
                ctes.append(f"{cur} as materialized (select {_others(cols, new)} from {src})")
            older[k], ver[k] = ver[k], f"{tag}"
            ctes.append(f"a{tag} as materialized (select idx, {', '.join(names)} from {cur})")
            ctes.append(f"g{tag} as materialized ({gram_row_sql(f'a{tag}', rank)})")
        fac = "a{}".format
        name = {w: fac(ver[w]) for w in range(n)}
        on = " ".join(f"join {name[w]} on c.i{w} = {name[w]}.idx" for w in range(n))
        core = ", ".join(
            f"sum(c.{v} * " + " * ".join(f"{name[w]}.{s}{r}" for w in range(n)) + f") as {p}_{r}"
            for p, v, s in CORE + (("inx", "x", "x"), ("iny", "y", "y")) for r in range(rank)
        )
        ctes.append(f"core{it} as materialized (select {core} from cells c {on})")
        ctes.append(
            f"fa{it} as materialized ({_gram_product(range(n), rank, lambda w: f'g{ver[w]}')})"
        )
        own = {
            s: [" + ".join(f"g{ver[w]}.{s}_{r}_{r}" for w in range(n)) for r in range(rank)]
            for s in ("x", "y")
        }
        mix = [" + ".join(f"g{ver[w]}.cross_{r}" for w in range(n)) for r in range(rank)]
        raw = []
        for r in range(rank):
            dx = (
                f"({l1} * (wx{r} * fx_{r}_{r} - gzx_{r}) - {l2} * ((1 - wx{r}) * fx_{r}_{r} - gsx_{r})"
                f" + {l3} * (-((1 - wx{r}) * ({own['x'][r]}) - (1 - wy{r}) * ({mix[r]}))))"
            )
            dy = (
                f"({l1} * (wy{r} * fy_{r}_{r} - gzy_{r}) - {l2} * ((1 - wy{r}) * fy_{r}_{r} - gsy_{r})"
                f" + {l3} * ((1 - wx{r}) * ({mix[r]}) - (1 - wy{r}) * ({own['y'][r]})))"
            )
            for s, dd in (("x", dx), ("y", dy)):
                v = f"(z{s}{r} - {dd} / nf{s})"
                raw.append(f"case when {v} < {e} then 0.0 else {v} end as r{s}{r}")
        olds = ", ".join(f"w{s}{r}" for s in ("x", "y") for r in range(rank))
        grams = ", ".join(f"g{ver[w]}" for w in range(n))
        ctes.append(
            f"wr{it} as materialized (select {', '.join(raw)}, {olds} from core{it}, fa{it}, {wt}, {grams})"
        )
        inner = ", ".join(
            " + ".join(f"in{s}_{r}" for r in range(rank)) + f" as in{s}" for s in ("x", "y")
        )
        model = {
            s: " + ".join(f"f{s}_{p}_{q}" for p in range(rank) for q in range(rank)) for s in ("x", "y")
        }
        part = {
            s: f"sqrt(greatest(n{s} * n{s} + {model[s]} - 2 * in{s}, 0.0)) / n{s}" for s in ("x", "y")
        }
        ctes.append(
            f"cost{it} as materialized (select ({part['x']} + {part['y']}) / 2 as cost "
            f"from (select {inner} from core{it}), fa{it}, nrm)"
        )
        following = (1 + (4 * momentum**2 + 1) ** 0.5) / 2
        push = "push" if ahead else f"cast({(momentum - 1) / following!r} as double)"
        momentum = following
        if ahead:
            new_a = "(1 + sqrt(4 * a * a + 1)) / 2"
            rises = f"cost{it}.cost > cost{it - 1}.cost"
            ctes.append(
                f"mo{it} as materialized (select case when {rises} then 1.0 else {new_a} end as a, "
                f"case when {rises} then 0.0 else (a - 1) / ({new_a}) end as push "
                f"from mo{it - 1}, cost{it}, cost{it - 1})"
            )
        total = {s: "(" + " + ".join(f"r{s}{r}" for r in range(rank)) + ")" for s in ("x", "y")}
        new_w = ", ".join(
            f"r{s}{r} / {total[s]} as w{s}{r}, "
            f"r{s}{r} / {total[s]} + {push} * (r{s}{r} / {total[s]} - w{s}{r}) as z{s}{r}"
            for s in ("x", "y") for r in range(rank)
        )
        ctes.append(f"wt{it} as materialized (select {new_w} from wr{it}{f', mo{it}' if ahead else ''})")
    return ctes, ver


def fit_rows(fixture: str, rank: int, iterations: int, ver: dict, weights: str | None) -> str:
    n = WAYS[fixture]
    parts = [
        f"select 'cost' as item, {it} as idx, 0 as r, round(cost, 7) as value from cost{it}"
        for it in range(1, iterations + 1)
    ]
    for s in ("x", "y"):
        for r in range(rank):
            w = f"w{s}{r}" if weights else f"cast({1.0 / rank!r} as double)"
            parts.append(
                f"select 'weight_{s}', 0, {r}, round({w}, 7)" + (f" from {weights}" if weights else "")
            )
            for k in range(n):
                digits = 4 if k == n - 1 else 7
                parts.append(
                    f"select 'factor{k}_{s}', idx, {r}, round({s}{r}, {digits}) + 0.0 from a{ver[k]}"
                )
    return " union all ".join(parts)


def pairwise_oracle(fixture: str, rank: int, iterations: int, ahead: bool = False) -> str:
    ctes, ver = pairwise_ctes(fixture, rank, iterations, ahead=ahead)
    return with_(ctes, fit_rows(fixture, rank, iterations, ver, f"wt{iterations}"))


def way_step_oracle(fixture: str, rank: int) -> str:
    """Factor of way 0 after its first update."""
    ctes, _ = pairwise_ctes(fixture, rank, 1)
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    end = next(i for i, c in enumerate(ctes) if c.startswith("g1_0 as"))
    return with_(ctes[:end], f"select idx, {rounded(names, 7)} from a1_0")


def weight_step_oracle(fixture: str, rank: int) -> str:
    ctes, _ = pairwise_ctes(fixture, rank, 1)
    parts = [
        f"select '{s}' as side, {r} as r, round(w{s}{r}, 7) as w, round(z{s}{r}, 7) as z from wt1"
        for s in ("x", "y") for r in range(rank)
    ]
    return with_(ctes, " union all ".join(parts))


def baseline_ctes(
    fixture: str, rank: int, k: int, iterations: int, alpha=1e-4, beta=1e-4, eps=1e-16, seed: int = 1
):
    n = WAYS[fixture]
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    ctes = start_ctes(fixture, rank, seed)
    a, b, e = (f"cast({v!r} as double)" for v in (alpha, beta, eps))
    ver = {w: f"0_{w}" for w in range(n)}
    for it in range(1, iterations + 1):
        fac = {w: f"a{ver[w]}" for w in range(n)}
        new_ver = {}
        for way in range(n):
            tag = f"{it}_{way}"
            over = [w for w in range(n) if w != way]
            ctes.append(
                f"ff{tag} as materialized ({_gram_product(over, rank, lambda w: f'g{ver[w]}')})"
            )
            sums = ", ".join(
                f"sum(c.{v} * " + " * ".join(f"{fac[w]}.{side}{r}" for w in over) + f") as {p}{r}"
                for p, v, side in FUSED[:2] for r in range(rank)
            )
            on = " ".join(f"join {fac[w]} on c.i{w} = {fac[w]}.idx" for w in over)
            ctes.append(f"m{tag} as materialized (select c.i{way} as idx, {sums} from cells c {on} group by 1)")
            ms = term_names(FUSED[:2], rank)
            filled = ", ".join(f"coalesce(m{tag}.{c}, 0.0) as {c}" for c in ms)
            tails = ", ".join(
                (" + ".join(f"a.{s}{r}" for r in range(k, rank)) or "0.0") + f" as t{s}" for s in ("x", "y")
            )
            cur = f"s{tag}_start"
            ctes.append(
                f"{cur} as materialized (select a.idx, {', '.join('a.' + c for c in names)}, {filled}, {tails} "
                f"from {fac[way]} a left join m{tag} on a.idx = m{tag}.idx)"
            )
            cols = ["idx", *names, *ms, "tx", "ty"]
            for l in range(rank):
                p = " + ".join(f"x{j} * fx_{j}_{l}" for j in range(rank))
                q = " + ".join(f"y{j} * fy_{j}_{l}" for j in range(rank))
                f, g = f"fx_{l}_{l}", f"fy_{l}_{l}"
                if l < k:
                    new_x = (
                        f"x{l} * {f} / ({f} + nx * {a}) + (mx{l} - ({p}) + nx * {a} * y{l})"
                        f" / ({f} + nx * {a} + {e})"
                    )
                    new_y = (
                        f"y{l} * {g} / ({g} + ny * {a}) + (my{l} - ({q}) + ny * {a} * x{l})"
                        f" / ({g} + ny * {a} + {e})"
                    )
                else:
                    new_x = f"x{l} + (mx{l} - ({p}) - (nx * {b} / 2) * ty) / ({f} + {e})"
                    new_y = f"y{l} + (my{l} - ({q}) + (ny * {b} / 2) * tx) / ({g} + {e})"
                for part, new in (("x", {f"x{l}": new_x}), ("y", {f"y{l}": new_y})):
                    nxt = f"s{tag}_{l}{part}"
                    ctes.append(
                        f"{nxt} as materialized (select {_others(cols, new)} from {cur}, ff{tag}, nrm)"
                    )
                    cur = nxt
                new = {f"{s}{l}": f"case when {s}{l} < {e} then {e} else {s}{l} end" for s in ("x", "y")}
                ctes.append(f"s{tag}_{l} as materialized (select {_others(cols, new)} from {cur})")
                cur = f"s{tag}_{l}"
            if way < n - 1:
                norms = ", ".join(f"sqrt(sum({c} * {c})) as n_{c}" for c in names)
                scaled = ", ".join(f"{c} / n_{c} as {c}" for c in names)
                ctes.append(
                    f"a{tag} as materialized (select idx, {scaled} from {cur}, (select {norms} from {cur}))"
                )
            else:
                ctes.append(f"a{tag} as materialized (select idx, {', '.join(names)} from {cur})")
            ctes.append(f"g{tag} as materialized ({gram_row_sql(f'a{tag}', rank)})")
            new_ver[way] = tag
        ver = new_ver
        name = {w: f"a{ver[w]}" for w in range(n)}
        on = " ".join(f"join {name[w]} on c.i{w} = {name[w]}.idx" for w in range(n))
        inner = ", ".join(
            f"sum(c.{s} * (" + " + ".join(
                " * ".join(f"{name[w]}.{s}{r}" for w in range(n)) for r in range(rank)
            ) + f")) as in{s}"
            for s in ("x", "y")
        )
        ctes.append(f"core{it} as materialized (select {inner} from cells c {on})")
        ctes.append(f"fa{it} as materialized ({_gram_product(range(n), rank, lambda w: f'g{ver[w]}')})")
        model = {
            s: " + ".join(f"f{s}_{p}_{q}" for p in range(rank) for q in range(rank)) for s in ("x", "y")
        }
        part = {
            s: f"sqrt(greatest(n{s} * n{s} + {model[s]} - 2 * in{s}, 0.0)) / n{s}" for s in ("x", "y")
        }
        ctes.append(
            f"cost{it} as materialized (select ({part['x']} + {part['y']}) / 2 as cost from core{it}, fa{it}, nrm)"
        )
    return ctes, ver


def baseline_oracle(fixture: str, rank: int, k: int, iterations: int) -> str:
    ctes, ver = baseline_ctes(fixture, rank, k, iterations)
    return with_(ctes, fit_rows(fixture, rank, iterations, ver, None))


def baseline_step_oracle(fixture: str, rank: int, k: int) -> str:
    ctes, ver = baseline_ctes(fixture, rank, k, 1)
    names = [f"{s}{r}" for s in ("x", "y") for r in range(rank)]
    parts = [f"select {w} as way, idx, {rounded(names, 5)} from a{ver[w]}" for w in ver]
    return with_(ctes, " union all ".join(parts))


def sweep_oracle(fixture: str, rank: int, k: int, trials: int) -> str:
    """Final cost rows of one pairwise and one baseline run after a single iteration."""
    parts = []
    for method, lam in (("pairwise", 0.1), ("baseline", 1e-4)):
        for t in range(trials):
            if method == "pairwise":
                ctes, _ = pairwise_ctes(fixture, rank, 1, seed=1 + t)
            else:
                ctes, _ = baseline_ctes(fixture, rank, k, 1, seed=1 + t)
            parts.append(
                f"select {t} as iter, 0 as elapsed, (" + with_(ctes, "select round(cost, 7) from cost1")
                + f") as cost, {t} as \"trial_ID\", 'case' as ground_truth_k, 'case' as k, "
                "cast(0.01 as double) as noise, cast(10 as double) as train_proportion, "
                f"cast({lam!r} as double) as alpha, cast({lam!r} as double) as beta, "
                f"cast(1e-8 as double) as delta, cast(0.1 as double) as gamma, {k} as distance, "
                f"'{method}' as method, 0 as seed, {rank} as rank"
            )
    return " union all ".join(parts)


def _setting_ctes(fixture: str, setting: tuple, iterations: int, k: int, trial: int):
    """Tables of one trial of a (method, rank, alpha, beta) setting."""
    method, rank, a, b = setting
    if method == "pairwise":
        return pairwise_ctes(fixture, rank, iterations, (a, b, 0.1), seed=1 + trial)
    return baseline_ctes(fixture, rank, k, iterations, a, b, seed=1 + trial)


def _setting_columns(setting: tuple, trial: int) -> str:
    method, rank, a, b = setting
    return (
        f"'{method}' as method, {rank} as rank, cast({a!r} as double) as alpha, "
        f"cast({b!r} as double) as beta, {trial} as \"trial_ID\""
    )


def settings_oracle(fixture: str, settings: list[tuple], k: int, trials: int) -> str:
    """Costs of every setting and trial after one iteration."""
    parts = []
    for setting in settings:
        for t in range(trials):
            ctes, _ = _setting_ctes(fixture, setting, 1, k, t)
            cost = with_(ctes, "select round(cost, 7) from cost1")
            parts.append(f"select {_setting_columns(setting, t)}, ({cost}) as cost")
    return " union all ".join(parts)


def resumed_oracle(fixture: str, settings: list[tuple], trials: int, iterations: int, k: int = 1) -> str:
    """Cost of every setting, trial and iteration, each in one row."""
    parts = []
    for setting in settings:
        for t in range(trials):
            ctes, _ = _setting_ctes(fixture, setting, iterations, k, t)
            rows = " union all ".join(
                f"select {it} as iter, round(cost, 7) as cost from cost{it}" for it in range(1, iterations + 1)
            )
            parts.append(
                f"select {_setting_columns(setting, t)}, iter, 1::bigint as n_rows, cost from ({with_(ctes, rows)})"
            )
    return " union all ".join(parts)


def sweep_weights_oracle(
    fixture: str, settings: list[tuple], trials: int, iterations: int, rank: int, k: int = 1
) -> str:
    """Final weights of both sides for the settings of one rank."""
    parts = []
    for setting in settings:
        for t in range(trials if setting[1] == rank else 0):
            method, _, a, b = setting
            ctes, _ = _setting_ctes(fixture, setting, iterations, k, t)
            for s in ("x", "y"):
                if method == "pairwise":
                    ws = ", ".join(f"round(w{s}{r}, 7) as w{r}" for r in range(rank))
                    rows = with_(ctes, f"select {ws} from wt{iterations}")
                else:
                    rows = "select " + ", ".join(f"round(cast({1.0 / rank!r} as double), 7) as w{r}" for r in range(rank))
                parts.append(
                    f"select '{method}' as method, cast({a!r} as double) as alpha, cast({b!r} as double) as beta, "
                    f"{t} as \"trial_ID\", '{s.upper()}' as tensor, * from ({rows})"
                )
    return " union all ".join(parts)


def stop_oracle(fixture: str, rank: int, stops: list[tuple[int, float]], most: int) -> str:
    """First iteration after the first whose cost changed by less than the tolerance, else ``most``."""
    parts = []
    for seed, tolerance in stops:
        ctes, _ = pairwise_ctes(fixture, rank, most, seed=seed)
        t = f"cast({tolerance!r} as double)"
        settled = " ".join(
            f"when abs(cost{it}.cost - cost{it - 1}.cost) < {t} then {it}" for it in range(2, most)
        )
        row = with_(
            ctes,
            f"select case {settled} else {most} end as iterations, "
            + ", ".join(f"cost{it}.cost as c{it}" for it in range(1, most + 1))
            + f" from {', '.join(f'cost{it}' for it in range(1, most + 1))}",
        )
        cost = "case iterations " + " ".join(f"when {it} then c{it}" for it in range(1, most + 1)) + " end"
        parts.append(f"select {seed} as seed, {t} as tolerance, iterations, round({cost}, 7) as cost from ({row})")
    return " union all ".join(parts)
