"""Queries of neighbourhood operators, noise, metering and tables of parameters, over a grid made of events."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.functions import colour as C
from emulsa.functions.noise import with_fbm, with_noise, with_scatter
from emulsa.kernels.noise import FIELD, M1, M2, MS, MX, MY
from emulsa.operators import marks as K
from emulsa.operators import meter as M
from emulsa.operators import neighbour as N
from emulsa.params import ops as P
from emulsa.params.catalog import DEFAULTS, PARAMS

from . import plates, sql as S

KEPT: dict[str, tuple] = {}
E = plates.EVENTS


def _put(name: str, f, columns: list[str], oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(plates.events(spark, sf_dir)).select("image_id", "y", "x", *[plates.quantised(F.col(c)).alias(c) for c in columns])

    KEPT[name] = (run, oracle)


def _out(source: str, columns: dict[str, str]) -> str:
    return S.out(source, columns, "image_id, y, x")


def blur(source: str, cols: list[str], sigma: float) -> str:
    """Reflected separable gaussian in SQL: a join with the kernel's taps on each axis."""
    for axis, across in (("x", "y"), ("y", "x")):
        turn = "greatest(2 * (n.n - 1), 1)"
        turned = f"(((p.{axis} + k.d) % {turn} + {turn}) % {turn})"
        bell = f"exp(-(d * d) / (2 * {S.n(sigma)} * {S.n(sigma)}))"
        kernel = f"select d, {bell} / sum({bell}) over () as w from (select unnest(range(-ceil(3 * {S.n(sigma)})::int, ceil(3 * {S.n(sigma)})::int + 1)) as d)"
        sums = ", ".join(f"sum(k.w * q.{c}) as {c}" for c in cols)
        source = (
            f"with p as ({source}), n as (select max({axis}) + 1 as n from p), k as ({kernel}), s as (select p.image_id, p.y, p.x, {sums} from p cross join n cross join k "
            f"join p q on q.image_id = p.image_id and q.{across} = p.{across} and q.{axis} = least({turned}, {turn} - {turned}) group by 1, 2, 3) "
            f"select p.* replace ({', '.join(f's.{c} as {c}' for c in cols)}) from p join s using (image_id, y, x)"
        )
    return source


def copies(source: str, cols: dict[str, str]) -> str:
    return f"select *, {', '.join(f'{e} as {c}' for c, e in cols.items())} from ({source})"


RGB = list("rgb")
_B = blur(copies(E, {f"{c}_b": c for c in RGB}), [f"{c}_b" for c in RGB], 1.5)
_put("gaussian_blur", lambda d: N.blur(d, RGB, 1.5), RGB, _out(blur(E, RGB, 1.5), {c: c for c in RGB}))
# Cells of two by two; what their means blur is taken off the sigma of the small grid.
_SMALL = f"select image_id, (y // 2)::int as y, (x // 2)::int as x, {', '.join(f'avg({c}) as {c}' for c in RGB)} from ({E}) group by 1, 2, 3"
_CUBIC = lambda t: f"(case when abs({t}) <= 1 then (1.25e0 * abs({t}) - 2.25e0) * {t} * {t} + 1 else -0.75e0 * (((abs({t}) - 5) * abs({t}) + 8) * abs({t}) - 4) end)"
_put("decimated_blur", lambda d: N.decimated_blur(d, RGB, 36.0), RGB, (
    f"with s as ({blur(_SMALL, RGB, ((36 * 36 - 3 / 12) ** 0.5) / 2)}), n as (select max(y) as h, max(x) as w from s), p as (select image_id, y, x, (y + 0.5e0) / 2 - 0.5e0 as v, (x + 0.5e0) / 2 - 0.5e0 as u from ({E})), "
    f"d as (select unnest(range(-1, 3)) as d), t as (select p.image_id, p.y, p.x, floor(v)::int + dy.d as cy, floor(u)::int + dx.d as cx, {_CUBIC('(v - floor(v) - dy.d)')} * {_CUBIC('(u - floor(u) - dx.d)')} as w from p cross join d dy cross join d dx) "
    f"select t.image_id, t.y, t.x, {', '.join(f'{S.q(f'sum(t.w * s.{c})')} as {c}' for c in RGB)} from t cross join n join s on s.y = greatest(0, least(cy, n.h)) and s.x = greatest(0, least(cx, n.w)) group by 1, 2, 3"))  # fmt: skip
_put("unsharp", lambda d: N.unsharp(d, 0.8, 1.5), RGB, _out(_B, {c: f"{c} + ({c} - {c}_b) * 0.8e0" for c in RGB}))
_L = blur(copies(E, {"l": S.luma(), "l_b": S.luma()}), ["l_b"], 2.0)
_put("clarity", lambda d: N.clarity(d, 0.5, 2.0), RGB, _out(_L, {c: S.clamp(f"{c} + 0.8e0 * (l - l_b)") for c in RGB}))
_put("micro_blur", lambda d: N.linear_blur(d, 1.0), RGB, _out(blur(f"select * replace ({', '.join(f'{S.linear(c)} as {c}' for c in RGB)}) from ({E})", RGB, 1.0), {c: S.clamp(S.display(c)) for c in RGB}))
_put("acutance", lambda d: N.with_blur(d, RGB, 1.5).withColumns({c: F.col(c) + (F.col(c) - F.col(f"{c}_b")) * 0.35 * 0.6 for c in RGB}), RGB, _out(_B, {c: f"{c} + ({c} - {c}_b) * 0.35e0 * 0.6e0" for c in RGB}))
_EDGE = copies(copies(_B, {"yh": f"abs({S.luma('(r - r_b)', '(g - g_b)', '(b - b_b)')})", "top": "greatest(abs(r - r_b), abs(g - g_b), abs(b - b_b))"}), {"edge": "yh + 0.7e0 * greatest(0e0, top - yh)"})
_put("edge_magnitude", lambda d: N.edge_magnitude(d, 1.5, 0.7), ["edge"], _out(_EDGE, {"edge": "edge"}))
_MASK = blur(f"select image_id, y, x, {S.clamp('edge / 0.06e0')} as edge from ({_EDGE})", ["edge"], 1.2)
_put("edge_mask", lambda d: N.edge_mask(d, 1.5, 1.0, 0.7), ["edge"], _out(_MASK, {"edge": "edge"}))
_LM = blur(f"select image_id, y, x, {S.luma()} as m from ({E})", ["m"], 3.0)
_UP, _DOWN = S.smoother(S.ramp(0.0, 0.15, "m")), S.smoother(S.ramp(0.65, 0.9, "m"))
_put("luminance_mask", lambda d: N.luminance_mask(d, DEFAULTS, limit=9), ["m"], _out(_LM, {"m": f"(0.4e0 + 0.6e0 * {_UP}) * (0.15e0 + 0.85e0 * (1 - {_DOWN}))"}))
_put("dilate", lambda d: N.dilate(d, RGB, 2), RGB, f"with p as ({E}) select p.image_id, p.y, p.x, {', '.join(f'{S.q(f'max(q.{c})')} as {c}' for c in RGB)} from p join p q on q.y between p.y - 2 and p.y + 2 and q.x between p.x - 2 and p.x + 2 group by 1, 2, 3")
_put("box_pool", lambda d: N.box_pool(d, 2), RGB, f"select image_id, (y // 2)::int as y, (x // 2)::int as x, {', '.join(f'{S.q(f'avg({c})')} as {c}' for c in RGB)} from ({E}) group by 1, 2, 3")
_ISO = blur(f"select image_id, y, x, {S.luma()} as v from ({E})", ["v"], 1.0)
_put("isophote", lambda d: N.gradient(N.blur(d.withColumn("v", C.luma(*map(F.col, RGB))), ["v"], 1.0), "v"), ["gx", "gy"], (
    f"with p as ({_ISO}), n as (select max(y) as h, max(x) as w from p) select p.image_id, p.y, p.x, {S.q('(e.v - w_.v) * 0.5e0')} as gx, {S.q('(s.v - t.v) * 0.5e0')} as gy from p cross join n "
    "join p e on e.y = p.y and e.x = least(p.x + 1, n.w) join p w_ on w_.y = p.y and w_.x = greatest(p.x - 1, 0) join p s on s.x = p.x and s.y = least(p.y + 1, n.h) join p t on t.x = p.x and t.y = greatest(p.y - 1, 0)"))  # fmt: skip
_SR = 2.0
_put("smooth_guard", lambda d: _guard(d), ["guard"], _out(blur(f"select image_id, y, x, abs(l - l_b) as t from ({_L})", ["t"], _SR), {"guard": f"0.15e0 + 0.85e0 * {S.smooth(S.ramp(0.002, 0.015, 't'))}"}))


def _guard(d: DataFrame) -> DataFrame:
    """How much grain smooth areas take."""
    b = N.with_blur(d.select("image_id", "y", "x", C.luma(*map(F.col, RGB)).alias("l")), ["l"], _SR)
    return N.blur(b.select("image_id", "y", "x", F.abs(F.col("l") - F.col("l_b")).alias("t")), ["t"], _SR).withColumn("guard", 0.15 + 0.85 * C.smoothstep(0.002, 0.015, F.col("t")))


_COLOUR = (1.0, 0.14 + 0.86 * 11 / 60, 0.14)  # hue 11, saturation 0.86, value 1
_THR = ((0.5 + 0.055) / 1.055) ** 2.4
_LIN = f"select * replace ({', '.join(f'{S.linear(c)} as {c}' for c in RGB)}) from ({E})"
_GLOW = blur(copies(_LIN, {"glow": S.clamp(f"({S.luma()} - {S.n(_THR)}) / {S.n(1 - _THR)}")}), ["glow"], 2.0)
_put("halation", lambda d: N.halation(d, 0.35, 2.0, 0.5, _COLOUR), RGB, _out(f"select * replace ({', '.join(f'{c} + glow * {S.n(k * 0.9 * 0.35)} as {c}' for c, k in zip(RGB, _COLOUR, strict=True))}) from ({_GLOW})", {c: S.display(c) for c in RGB}))
# The whole stage: highlights spread, bright blues (hue 230, by the displayed colours) turned by 20 degrees and strengthened by half, highlights recovered by 0.4.
_WHOLE = {"halation": 0.5, "halation_radius": 2.0, "halation_threshold": 0.5, "halation_recovery": 0.4, "halation_blue": 0.5, "halation_blue_shift": 20.0, "halation_blue_level": 0.4, "halation_blue_falloff": 0.3}
_H = copies(_GLOW, {f"s_{c}": S.display(c) for c in RGB})
_H = copies(_H, {"hi": "greatest(s_r, s_g, s_b)", "lo": "least(s_r, s_g, s_b)", "sy": S.luma("s_r", "s_g", "s_b")})
_H = copies(_H, {"hue": "case when hi - lo < 1e-6 then 0e0 when hi = s_r then 60 * (((s_g - s_b) / (hi - lo) + 6) % 6) when hi = s_g then 60 * ((s_b - s_r) / (hi - lo) + 2) else 60 * ((s_r - s_g) / (hi - lo) + 4) end", "sat": "(hi - lo) / greatest(hi, 1e-6)"})
_H = copies(_H, {"away": "abs((hue - 50 + 360) % 360 - 180)"})
_H = copies(_H, {"m": f"(1 - {S.smooth(S.ramp(0.0, 70.0, 'away'))}) * {S.smooth(S.ramp(0.0, 0.12, 'sat'))} * {S.smoother(S.ramp(0.4 - 0.3, 0.4, 'sy'))}"})
_H = copies(_H, {"co": "cos(radians(m * 20e0))", "si": "sin(radians(m * 20e0))", "mean": "(r + g + b) / 3"})
_H = copies(_H, {f"t_{c}": f"{c} * co + ({x} - {y}) * si / sqrt(3e0) + mean * (1 - co)" for c, x, y in (("r", "b", "g"), ("g", "r", "b"), ("b", "g", "r"))})
_H = copies(_H, {"ty": S.luma("t_r", "t_g", "t_b")})
_H = copies(_H, {**{f"u_{c}": f"greatest(0e0, ty + (t_{c} - ty) * (1 + 0.5e0 * m))" for c in RGB}, **{f"a_{c}": f"glow * {S.n(k * 0.9 * 0.5)}" for c, k in zip(RGB, _COLOUR, strict=True)}})
_H = copies(_H, {f"e_{c}": f"greatest(1 - u_{c}, 1e-4)" for c in RGB})
_H = copies(_H, {f"z_{c}": f"u_{c} + a_{c} * (e_{c} + a_{c} * 0.6e0) / (e_{c} + a_{c})" for c in RGB})
_put("halation_whole", lambda d: N.halation_stage(d, _WHOLE, _COLOUR), RGB, _out(_H, {c: S.display(f"z_{c}") for c in RGB}))
_T = (
    f"with p as ({_ISO}), n as (select max(y) as h, max(x) as w from p) select p.image_id, p.y, p.x, (e.v - w_.v) * 0.5e0 as gx, (s.v - t.v) * 0.5e0 as gy from p cross join n "
    "join p e on e.y = p.y and e.x = least(p.x + 1, n.w) join p w_ on w_.y = p.y and w_.x = greatest(p.x - 1, 0) join p s on s.x = p.x and s.y = least(p.y + 1, n.h) join p t on t.x = p.x and t.y = greatest(p.y - 1, 0)")  # fmt: skip
_T = copies(_T, {"size": "greatest(sqrt(gx * gx + gy * gy), 1e-6)"})
_put("isophote_tangent", lambda d: N.isophote(d.withColumn("v", C.luma(*map(F.col, RGB))), "v", 1.0), ["ty", "tx", "size"], _out(_T, {"ty": "gx / size", "tx": "-gy / size", "size": "size"}))
_MOVE = ("(x * 7 + y * 3) % 5 - 2", "(x * 5 + y * 11) % 5 - 2")
_put("scatter_nearest", lambda d: N.shifted(d, F.expr(_MOVE[0]), F.expr(_MOVE[1])), RGB, (
    f"with p as ({E}), n as (select max(y) as h, max(x) as w from p) select p.image_id, p.y, p.x, {', '.join(f'{S.q(f'q.{c}')} as {c}' for c in RGB)} from p cross join n join p q on q.y = greatest(0, least(p.y + ({_MOVE[0].replace('x', 'p.x').replace('y', 'p.y')}), n.h)) "
    f"and q.x = greatest(0, least(p.x + ({_MOVE[1].replace('x', 'p.x').replace('y', 'p.y')}), n.w))"))  # fmt: skip


def lattice(iy: str, ix: str, seed: int) -> str:
    """The hash in unsigned 128-bit arithmetic modulo 2^64, as nested selects would be: text for one point."""
    m = "18446744073709551616::uhugeint"
    wrap = lambda v: f"(case when {v} < 0 then ({m} - (-({v}))::uhugeint) else ({v})::uhugeint end)"
    n0 = f"(({wrap(ix)} * {MX}::uhugeint % {m} + {wrap(iy)} * {MY}::uhugeint % {m} + {seed * MS % (1 << 64)}::uhugeint) % {m})"
    step = lambda n, k, mul: f"list_transform([{n}], lambda z: (xor(z, z >> {k}) * {mul}::uhugeint) % {m})[1]"
    n2 = step(step(n0, 29, M1), 32, M2)
    return f"list_transform([{n2}], lambda z: (xor(z, z >> 31) >> 40)::double / 16777216e0)[1]"


_put("lattice_hash", lambda d: with_noise(d, "lattice", "v", 1234, field=2), ["v"], _out(E, {"v": lattice("y", "x", 1234 + 2 * FIELD)}))
_put("cell_noise", lambda d: with_noise(d, "cell", "v", 77, 3.2), ["v"], _out(E, {"v": lattice("floor(y / 3.2e0)::bigint", "floor(x / 3.2e0)::bigint", 77)}))


def value(source: str, cell: float, seed: int, name: str) -> str:
    """source with a column of smooth noise."""
    v = copies(copies(source, {"iy": f"floor(y / {S.n(cell)})::bigint", "ix": f"floor(x / {S.n(cell)})::bigint"}), {"ty": f"y / {S.n(cell)} - iy", "tx": f"x / {S.n(cell)} - ix"})
    v = copies(v, {"fy": S.smoother("ty"), "fx": S.smoother("tx"), **{f"c{a}{b}": lattice(f"(iy + {a})", f"(ix + {b})", seed) for a in (0, 1) for b in (0, 1)}})
    return f"select * exclude (iy, ix, ty, tx, fy, fx, c00, c01, c10, c11) from ({copies(v, {name: '(c00 * (1 - fx) + c01 * fx) * (1 - fy) + (c10 * (1 - fx) + c11 * fx) * fy'})})"


_put("value_noise", lambda d: with_noise(d, "value", "v", 99, 3.2), ["v"], _out(value(E, 3.2, 99, "v"), {"v": "v"}))
# Three octaves from a cell of 1.7, with weights 1, 0.6, 0.36; fixed values: their seeds are 1301 apart, fields 7919.
_F = value(value(value(E, 1.7, 5 + 7919, "o1"), 3.4, 5 + 7919 + 1301, "o2"), 6.8, 5 + 7919 + 2602, "o3")
_put("fbm_noise", lambda d: with_fbm(d, ["u", "v"], 5, 1.7, 3, 0.6), ["v"], _out(_F, {"v": "0.5e0 + ((o1 + 0.6e0 * o2 + 0.36e0 * o3) / 1.96e0 - 0.5e0) * (1.96e0 / sqrt(1e0 + 0.36e0 + 0.1296e0))"}))


def scattered(pattern: int) -> str:
    """The grid with dy and dx: eight spokes, every second one short (6), or a diamond (4); seed 9, cell 1.5, reach 6, spread 0.5, share 0.7."""
    at = copies(E, {k: lattice("floor(y / 1.5e0)::bigint", "floor(x / 1.5e0)::bigint", 9 + 3301 + 7919 * i) for i, k in enumerate(("pick", "far", "gate"))})
    at = copies(at, {"k": "least(floor(pick * 8), 7)"})
    at = copies(at, {"theta": "k * (2e0 * pi() / 8)" if pattern == 6 else "pick * (2e0 * pi())"})
    shape = "case when k % 2 = 0 then 1e0 else 0.4e0 end" if pattern == 6 else "1 / greatest(abs(cos(theta)) + abs(sin(theta)), 1e-4)"
    at = copies(at, {"reach": f"6e0 * (1 - 0.5e0 * far) * ({shape})"})
    return copies(at, {"dy": "case when gate < 0.7e0 then round_even(reach * sin(theta), 0) else 0 end::int", "dx": "case when gate < 0.7e0 then round_even(reach * cos(theta), 0) else 0 end::int"})


KEPT["scatter_offsets"] = (lambda s, d: with_scatter(plates.events(s, d), 0.7, 6.0, 1.5, 9, 0.5, 4).select("image_id", "y", "x", "dy", "dx"), f"select image_id, y, x, dy, dx from ({scattered(4)})")
_put("scatter_gather", lambda d: N.shifted(with_scatter(d, 0.7, 6.0, 1.5, 9, 0.5, 6), F.col("dy"), F.col("dx")), RGB, (
    f"with p as ({scattered(6)}), n as (select max(y) as h, max(x) as w from p) select p.image_id, p.y, p.x, {', '.join(f'{S.q(f'q.{c}')} as {c}' for c in RGB)} from p cross join n "
    "join p q on q.y = greatest(0, least(p.y + p.dy, n.h)) and q.x = greatest(0, least(p.x + p.dx, n.w))"))  # fmt: skip


def _meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.meter(plates.line(spark, sf_dir))
    return m.select("image_id", *[F.floor(F.col(c) * 1e5 + 0.5).cast("bigint").alias(c) for c in m.columns if c != "image_id"])


def _meter_sql(source: str, whole: str | None = None) -> str:
    """whole: the pixels that the peak is taken of, if source has some of them only (one image)."""
    lin = f"select *, {', '.join(f'{S.linear(c)} as l{c}' for c in RGB)}, greatest(r, g, b) as top, least(r, g, b) >= 0.02e0 as seen, least(r, g, b) >= 0.02e0 and greatest(r, g, b) <= 0.92e0 as ok from ({source})"
    gain = lambda c: f"greatest({S.n(1 / 1.6)}, least(1.6e0, 1 + ((mr + mg + mb) / 3 / m{c} - 1) * damp))"
    white = lambda ev: f"greatest(1e0, {S.linear('peak')} * greatest(gr, gg, gb) * pow(2e0, {ev}))"
    return f"""
with lin as ({lin}),
a as (select image_id, count(*) filter (where seen) as n_seen, count(*) filter (where ok) as n_ok, {f'(select max(greatest(r, g, b)) from ({whole}))' if whole else 'max(top)'} as peak,
      {', '.join(f'greatest(pow(avg(pow(l{c}, 6e0)) filter (where ok), {S.n(1 / 6)}), 1e-6) as m{c}, avg(l{c} / greatest(lr + lg + lb, 1e-6)) filter (where ok) as c{c}' for c in RGB)} from lin group by 1),
d as (select image_id, avg(({' + '.join(f'abs(l{c} / greatest(lr + lg + lb, 1e-6) - c{c})' for c in RGB)}) / 3) filter (where ok) as diversity from lin join a using (image_id) group by 1),
e as (select *, {S.clamp('(diversity - 0.010e0) / 0.035e0')} as damp from a join d using (image_id)),
f as (select *, {', '.join(f'case when n_ok >= 256 then {gain(c)} else 1e0 end as h{c}' for c in RGB)} from e),
g as (select *, {', '.join(f'h{c} / {S.luma("hr", "hg", "hb")} as g{c}' for c in RGB)} from f),
k as (select image_id, exp(avg(ln(greatest({S.luma('lr * gr', 'lg * gg', 'lb * gb')}, 1e-6))) filter (where seen)) as key from lin join g using (image_id) group by 1),
h as (select *, {S.clamp('log2(0.179e0 / key)', -2, 2)} as ev from g join k using (image_id)),
i as (select *, {white('ev')} as white, key * pow(2e0, ev) as kk from h),
j as (select * replace ({S.clamp('ev + log2(0.179e0 / (kk * (1 + kk / (white * white)) / (1 + kk)))', -2, 2)} as ev) from i),
l as (select * replace ({white('ev')} as white) from j)
select image_id, case when n_seen >= 256 then ev else 0e0 end as norm_ev, {', '.join(f'case when n_seen >= 256 then g{c} else 1e0 end as norm_gain_{c}' for c in RGB)},
       case when n_seen >= 256 then {S.clamp('-ev / 2')} * 0.6e0 else 0e0 end as norm_toe, case when n_seen >= 256 then white else 1e0 end as norm_white from l"""


_METER = _meter_sql(plates.LINE)
_NAMES = ("norm_ev", "norm_gain_r", "norm_gain_g", "norm_gain_b", "norm_toe", "norm_white")
KEPT["meter"] = (_meter, f"select image_id, {', '.join(f'cast(floor({c} * 1e5 + 0.5e0) as bigint) as {c}' for c in _NAMES)} from ({_METER})")


# Groups of which some have fewer than 256 pixels that are measured, so nothing is applied to them.
_GROUPS = "select l_returnflag || '-' || (l_orderkey % 80) as image_id, l_quantity / 50e0 as r, l_discount * 10e0 as g, l_tax / 0.08e0 as b from lineitem"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return d.select(F.concat_ws("-", "l_returnflag", (F.col("l_orderkey") % 80).cast("string")).alias("image_id"), (F.col("l_quantity") / 50.0).alias("r"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") / 0.08).alias("b"))


_told = lambda m: m.select("image_id", *[F.floor(F.col(c) * 1e5 + 0.5).cast("bigint").alias(c) for c in _NAMES])
_asked = lambda sql: f"select image_id, {', '.join(f'cast(floor({c} * 1e5 + 0.5e0) as bigint) as {c}' for c in _NAMES)} from ({sql})"
KEPT["meter_small_images"] = (lambda s, d: _told(M.meter(_groups(s, d))), _asked(_meter_sql(_GROUPS)))
# Every third pixel in raster order, if there are three times 3,000 of them; the peak is that of all.
_EVERY = f"with p as ({E}), n as (select max(x) + 1 as w, greatest(1, count(*) // 3000) as stride from p) select p.* from p cross join n where (y::bigint * w + x) % stride = 0"
KEPT["meter_stride"] = (lambda s, d: _told(M.meter(plates.events(s, d), 3_000)), _asked(_meter_sql(_EVERY, E)))


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = plates.line(spark, sf_dir)
    return M.normalize(d, M.meter(d), 0.3).select("image_id", *[F.floor(F.col(c) * 1e4 + 0.5).cast("bigint").alias(c) for c in RGB])


_NA = f"select p.*, r as sr, g as sg, b as sb, m.* exclude (image_id) from ({plates.LINE}) p join ({_METER}) m using (image_id)"
_NA = f"select * replace ({', '.join(f'{S.linear(c)} * norm_gain_{c} * pow(2e0, norm_ev) as {c}' for c in RGB)}) from ({_NA})"
_NA = copies(copies(_NA, {"v": "greatest(r, g, b)"}), {"kf": "case when norm_white > 1 then v * (1 + v / (norm_white * norm_white)) / (1 + v) / greatest(v, 1e-6) else 1e0 end"})
_NA = f"select * replace ({', '.join(f'r_{c} as {c}' for c in RGB)}) from ({copies(copies(_NA, {f'q_{c}': f'{c} * kf' for c in RGB}), {f'r_{c}': S.display(f'q_{c}') for c in RGB})})"
_NA = copies(copies(_NA, {"v2": "greatest(r, g, b)"}), {"u": "greatest(0e0, (0.06e0 - v2) / 0.06e0)", "w": f"{S.smooth(S.ramp(0.15, 1.0, 'greatest(sr, sg, sb)'))} * 0.3e0"})
_NA = copies(_NA, {"f": "case when norm_toe > 0.001e0 then (case when v2 < 0.06e0 then 0.06e0 - 0.06e0 * (u + norm_toe * (1 - exp(-u) - u)) else v2 end) / greatest(v2, 1e-4) else 1e0 end"})
KEPT["normalize_apply"] = (_normalize, f"select image_id, {', '.join(f'cast(floor({S.clamp(f'{c} * f + (s{c} - {c} * f) * w')} * 1e4 + 0.5e0) as bigint) as {c}' for c in RGB)} from ({_NA})")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = plates.line(spark, sf_dir).withColumn("v", F.floor(C.luma(*map(F.col, RGB)) * 255 + 0.5).cast("int"))
    return d.groupBy("image_id").agg(F.count_distinct("v").alias("levels"), F.count("*").alias("pixels"))


KEPT["distinct_levels"] = (_levels, f"select image_id, count(distinct v) as levels, count(*) as pixels from (select image_id, floor({S.luma()} * 255 + 0.5e0)::int as v from ({plates.LINE})) group by 1")


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = plates.line(spark, sf_dir).withColumn("band", F.least(F.floor(C.luma(*map(F.col, RGB)) * 16), F.lit(15)).cast("int"))
    return d.groupBy("image_id", "band").agg(F.count("*").alias("pixels"), F.floor(F.stddev_pop("g") * 1e5 + 0.5).cast("bigint").alias("sigma"))


KEPT["luma_histogram"] = (_histogram, f"select image_id, band, count(*) as pixels, cast(floor(stddev_pop(g) * 1e5 + 0.5e0) as bigint) as sigma from (select image_id, g, least(floor({S.luma()} * 16), 15)::int as band from ({plates.LINE})) group by 1, 2")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter sets made of parts: a set for each brand, a value for each key."""
    keys = F.array(*[F.lit(p.key) for p in PARAMS], F.lit("unknown"))
    d = spark.read.parquet(f"{sf_dir}/part.parquet")
    return d.select(F.col("p_brand").alias("set_name"), F.get(keys, (F.col("p_partkey") % (len(PARAMS) + 1)).cast("int")).alias("key"), (F.col("p_size") * 1.0 - 20).alias("value"))


_CAT = " union all ".join(f"select '{p.key}' as key, {S.n(p.min)} as lo, {S.n(p.max)} as hi, {S.n(p.default)} as dflt, {str(p.spatial).lower()} as spatial" for p in PARAMS)
_SANE = (
    f"with c as ({_CAT}), k as (select key, row_number() over () - 1 as i from (select unnest([{', '.join(repr(p.key) for p in PARAMS)}]) as key)), g as (select p_brand as set_name, key, max(p_size * 1e0 - 20) as value from part join k on p_partkey % {len(PARAMS) + 1} = i group by 1, 2), "
    "n as (select distinct p_brand as set_name from part) select n.set_name, c.key, c.spatial, lo, hi, greatest(lo, least(hi, coalesce(value, dflt))) as value from n cross join c left join g using (set_name, key)"
)
KEPT["sanitize"] = (lambda s, d: P.sanitize_table(_sets(s, d)).select("set_name", "key", plates.quantised(F.col("value")).alias("value")), f"select set_name, key, {S.q('value')} as value from ({_SANE})")
KEPT["rescale"] = (lambda s, d: P.rescale_table(P.sanitize_table(_sets(s, d)), 0.5).select("set_name", "key", plates.quantised(F.col("value")).alias("value")), f"select set_name, key, {S.q('case when spatial then greatest(lo, least(hi, value * 0.5e0)) else value end')} as value from ({_SANE})")
KEPT["params_catalog"] = (lambda s, d: P.catalog(s).select("key", "min", "max", "default", "spatial"), f'select key, lo as min, hi as max, dflt as "default", spatial from ({_CAT})')


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile plan of the events grid."""
    size = plates.events(spark, sf_dir).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    at = size.select("h", "w", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / 32).cast("int") - 1)).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / 32).cast("int") - 1)).alias("tx"))
    edge = lambda t, n: (F.col(t) * 32, F.least(F.col(n), (F.col(t) + 1) * 32))
    (ya, yb), (xa, xb) = edge("ty", "h"), edge("tx", "w")
    pad = lambda a, b, n: (F.greatest(F.lit(0), a - 7), F.least(F.col(n), b + 7))
    (pa, pb), (pc, pd) = pad(ya, yb, "h"), pad(xa, xb, "w")
    return at.select("ty", "tx", *[e.alias(n) for e, n in zip((ya, yb, xa, xb, pa, pb, pc, pd), ("y_a", "y_b", "x_a", "x_b", "py_a", "py_b", "px_a", "px_b"), strict=True)])


KEPT["tile_plan"] = (_tiles, """
with s as (select max(y) + 1 as h, max(x) + 1 as w from (%s)), t as (select h, w, unnest(range(ceil(h / 32e0)::int))::int as ty from s), u as (select *, unnest(range(ceil(w / 32e0)::int))::int as tx from t),
v as (select *, (ty * 32)::int as y_a, least(h, ty * 32 + 32)::int as y_b, (tx * 32)::int as x_a, least(w, tx * 32 + 32)::int as x_b from u)
select ty, tx, y_a, y_b, x_a, x_b, greatest(0, y_a - 7)::int as py_a, least(h, y_b + 7)::int as py_b, greatest(0, x_a - 7)::int as px_a, least(w, x_b + 7)::int as px_b from v""" % E)


_DUST = DEFAULTS | {"dust": 20.0, "dust_size": 20.0, "dust_irregular": 0.5}


def _site_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = plates.events(spark, sf_dir).groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return K.site_tiles(K.dust_table(spark, _DUST), size, 32)


# Number, y, x and reach of the specks of seed 77, worked out apart from this package by the published formulas.
_SITES = """(0, 0.148639658, 0.270853776, 14.307139), (1, 0.729009675, 0.027693741, 20.062357), (2, 0.292200093, 0.762834504, 9.873166), (3, 0.867100681, 0.534402199, 14.593868), (4, 0.481431368, 0.310490419, 14.887335),
    (5, 0.046489328, 0.070987485, 14.573385), (6, 0.616006838, 0.800148214, 16.610095), (7, 0.163518075, 0.573579480, 29.280064), (8, 0.708649142, 0.317321044, 12.049683), (9, 0.327709518, 0.049663495, 19.008160),
    (10, 0.901642539, 0.846576755, 19.737169), (11, 0.457033074, 0.580792187, 25.657989), (12, 0.044725716, 0.324171254, 11.713824), (13, 0.605223775, 0.071626409, 14.612034), (14, 0.180644935, 0.830461350, 15.950981),
    (15, 0.752299602, 0.597893699, 21.257550), (16, 0.310244853, 0.381866105, 14.886963), (17, 0.857928376, 0.082383480, 14.828211), (18, 0.421523406, 0.847641860, 9.065954), (19, 0.984981942, 0.628964475, 14.461996)"""
KEPT["site_tile_join"] = (_site_tiles, f"""
with s as (select max(y) + 1 as h, max(x) + 1 as w from ({E})), t as (select h, w, unnest(range(ceil(h / 32e0)::int))::int as ty from s), u as (select *, unnest(range(ceil(w / 32e0)::int))::int as tx from t),
m as (select * from (values {_SITES}) as m(k, y, x, r))
select 'events' as image_id, k, ty, tx from u join m on floor(y * h - r) < least(h, ty * 32 + 32) and ceil(y * h + r) >= ty * 32 and floor(x * w - r) < least(w, tx * 32 + 32) and ceil(x * w + r) >= tx * 32""")
