"""Queries of the point operators, over colours without coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.functions import colour as C
from emulsa.operators import points as P
from emulsa.params.catalog import DEFAULTS

from . import plates, sql as S

RGB = ("r", "g", "b")
KEPT: dict[str, tuple] = {}


def _put(name: str, build, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = build(tuple(F.col(c) for c in RGB))
        return plates.line(spark, sf_dir).select("image_id", *[plates.quantised(e).alias(c) for c, e in columns.items()])

    KEPT[name] = (run, oracle)


def _put_frame(name: str, f, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(plates.line(spark, sf_dir)).select("image_id", *[plates.quantised(F.col(c)).alias(c) for c in RGB])

    KEPT[name] = (run, oracle)


def _rgb(x) -> dict:
    return dict(zip(RGB, x, strict=True))


def _each(f):
    return lambda c: _rgb(f(x) for x in c)


_put("srgb_linear", _each(C.linear), S.out(plates.LINE, S.rgb(S.linear)))
_put("linear_srgb", _each(C.display), S.out(plates.LINE, S.rgb(S.display)))
_put("luma", lambda c: {"y": C.luma(*c)}, S.out(plates.LINE, {"y": S.luma()}))
_put("smoothstep", _each(lambda x: C.smoothstep(0.2, 0.8, x)), S.out(plates.LINE, S.rgb(lambda c: S.smooth(S.ramp(0.2, 0.8, c)))))
_put("smootherstep", _each(lambda x: C.smootherstep(0.1, 0.9, x)), S.out(plates.LINE, S.rgb(lambda c: S.smoother(S.ramp(0.1, 0.9, c)))))
_put("spread", _each(C.spread), S.out(plates.LINE, S.rgb(lambda c: S.smooth(S.ramp(0.38, 0.78, c)))))

_HUE = "case when hi - lo < 1e-6 then 0e0 when hi = r then 60e0 * (((g - b) / (hi - lo)) - 6e0 * floor(((g - b) / (hi - lo)) / 6e0)) when hi = g then 60e0 * ((b - r) / (hi - lo) + 2) else 60e0 * ((r - g) / (hi - lo) + 4) end"
_HILO = S.steps(plates.LINE, {"hi": "greatest(r, g, b)", "lo": "least(r, g, b)"})
_put("hue_sat", lambda c: {"hue": C.hue(*c), "sat": C.saturation(*c)}, S.out(_HILO, {"hue": _HUE, "sat": "(hi - lo) / greatest(hi, 1e-6)"}))
_TURN = lambda a, b, c: f"{a} * cos(radians(25e0)) + ({b} - {c}) * sin(radians(25e0)) / {S.n(3**0.5)} + (r + g + b) / 3 * (1 - cos(radians(25e0)))"
_put("rotate_hue", lambda c: _rgb(C.rotate_hue(c, F.lit(25.0))), S.out(plates.LINE, {"r": _TURN("r", "b", "g"), "g": _TURN("g", "r", "b"), "b": _TURN("b", "g", "r")}))


def _knee(x: str, a: float, span: float) -> str:
    k = 1 - span * a
    return f"(case when {x} > {S.n(k)} then {S.n(k)} + {S.n(1 - k)} * tanh(({x} - {S.n(k)}) / {S.n(1 - k)}) else {x} end)"


_put("soft_knee", _each(lambda x: C.soft_knee(x, 0.6, 0.55)), S.out(plates.LINE, S.rgb(lambda c: _knee(c, 0.6, 0.55))))
_put("shoulder", _each(lambda x: C.shoulder(x)), S.out(plates.LINE, S.rgb(lambda c: f"1 - exp(-{c})")))


def _roll(t: str, a: float) -> str:
    return f"({t} + {S.n(a)} * (1 - exp(-{t}) - {t}))" if a >= 0 else f"({t} + {S.n(-a * 0.35)} * {S.smoother(S.clamp(t))} * (1 - {t}))"


_put("tone_roll", lambda c: {"up": C.tone_roll(c[0], 0.7), "down": C.tone_roll(c[1], -0.7)}, S.out(plates.LINE, {"up": _roll("r", 0.7), "down": f"g + {S.n(0.7)} * 0.35e0 * {S.smoother(S.clamp('g'))} * (1 - g)"}))


def _curve(source: str, contrast: float, toe: float, shoulder: float) -> str:
    return S.steps(
        source, S.rgb(lambda c: f"0.46e0 + ({c} - 0.46e0) * {S.n(1 + 1.1 * contrast)}"), S.rgb(lambda c: _knee(c, shoulder, 0.55)), S.rgb(lambda c: f"1 - {_knee(f'(1 - {c})', toe, 0.40)}")
    )


_put("characteristic_curve", _each(lambda x: C.characteristic_curve(x, 0.4, 0.3, 0.5)), S.out(_curve(plates.LINE, 0.4, 0.3, 0.5), S.rgb(lambda c: c)))
_GAINS = C.balance_gains(0.4, -0.2)
_put("white_balance", lambda c: _rgb(C.white_balance(c, 0.4, -0.2)), S.out(S.steps(plates.LINE, {c: f"{S.linear(c)} * {S.n(g)}" for c, g in zip(RGB, _GAINS, strict=True)}), S.rgb(S.display)))
_put("exposure", lambda c: _rgb(C.exposure(c, 0.75)), S.out(S.steps(plates.LINE, S.rgb(lambda c: f"{S.linear(c)} * {S.n(2**0.75)}")), S.rgb(S.display)))
_SH = S.steps(
    plates.LINE, {"v": "greatest(r, g, b)"}, {"th": "greatest(0e0, (v - 0.5e0) / 0.5e0)", "tl": "greatest(0e0, (0.5e0 - v) / 0.5e0)"},
    {"w": f"case when v > 0.5e0 then 0.5e0 + 0.5e0 * {_roll('th', 0.6)} when v < 0.5e0 then 0.5e0 - 0.5e0 * {_roll('tl', 0.4)} else v end"},
)
_put("shadows_highlights", lambda c: _rgb(C.shadows_highlights(c, 0.4, -0.6)), S.out(_SH, S.rgb(lambda c: S.clamp(f"{c} * (w / greatest(v, 1e-4))"))))
_put("contrast_blackpoint", _each(lambda x: C.black_point(C.contrast(x, 0.5), 0.05)), S.out(S.steps(plates.LINE, S.rgb(lambda c: S.clamp(f"0.46e0 + ({c} - 0.46e0) * 1.45e0"))), S.rgb(lambda c: S.clamp(f"({c} - 0.05e0) / {S.n(1 - 0.05)}"))))


def _vibrance(source: str, v: float) -> str:
    return S.steps(source, {"y0": S.luma(), "gain": f"greatest(0e0, 1 + {S.n(v)} * (1 - (greatest(r, g, b) - least(r, g, b)) / greatest(greatest(r, g, b), 1e-4)))"}, S.rgb(lambda c: f"y0 + ({c} - y0) * gain"))


_VS = S.steps(_vibrance(plates.LINE, 0.5), {"y1": S.luma()}, S.rgb(lambda c: f"y1 + ({c} - y1) * 0.8e0"))
_put("vibrance_saturation", lambda c: _rgb(C.saturate(C.vibrance(c, 0.5), -0.2)), S.out(_VS, S.rgb(lambda c: c)))

_TONE = DEFAULTS | {"brightness": 0.3, "contrast": 0.2, "toe": 0.2, "shoulder": 0.3, "highlight_desat": 0.4, "vibrance": 0.2, "highlight_warmth": 0.5, "shadow_warmth": -0.3, "base_fog": 0.02}
_T = _curve(S.steps(plates.LINE, S.rgb(lambda c: f"{S.linear(c)} * {S.n(2**0.3)}"), S.rgb(S.display)), 0.2, 0.2, 0.3)
_T = S.steps(_T, {"ya": S.luma()}, {"wa": f"{S.smooth(S.ramp(0.62, 1.0, 'ya'))} * 0.4e0"}, S.rgb(lambda c: f"{c} + wa * (ya - {c})"))
_T = S.steps(_vibrance(_T, 0.2), {"yb": S.luma()}, {"wb": f"{S.smooth(S.ramp(0.30, 0.85, 'yb'))} * 0.5e0 + (1 - {S.smooth(S.ramp(0.15, 0.70, 'yb'))}) * (-0.3e0)"})
_put_frame("tone_stage", lambda d: P.tone(d, _TONE), S.out(_T, {c: S.clamp(f"0.02e0 + 0.98e0 * ({c} + {S.n(a)} * wb)") for c, a in zip(RGB, C.warmth_axis(), strict=True)}))

_put("source_masks", lambda c: dict(zip(("mr", "mg", "mb", "ml"), C.source_masks(c, 0.4), strict=True)), S.out(S.steps(plates.LINE, {"y0": S.clamp(S.luma())}, {"tri": S.clamp("case when y0 < 0.4e0 then y0 / 0.4e0 else (1 - y0) / 0.6e0 end")}), {
    "mr": "greatest(0e0, r - greatest(g, b))", "mg": "greatest(0e0, g - greatest(r, b))", "mb": "greatest(0e0, b - greatest(r, g))", "ml": S.smooth("tri")}))
_BLEND = S.steps(plates.LINE, {"o": S.clamp("r"), "s": "(g - 0.5e0) * 0.5e0 + 0.5e0"})
_DODGE = "1 - 2 * (1 - o) * (1 - s)"
for _mode, _e in {
    "Add": "g - 0.5e0 + o", "Overlay": f"case when o <= 0.5e0 then 2 * o * s else {_DODGE} end", "Hard Light": f"case when s <= 0.5e0 then 2 * o * s else {_DODGE} end", "Multiply": "o * s", "Screen": "1 - (1 - o) * (1 - s)",
    "Soft Light": "case when s <= 0.5e0 then o - (1 - 2 * s) * o * (1 - o) else o + (2 * s - 1) * ((case when o <= 0.25e0 then ((16 * o - 12) * o + 4) * o else sqrt(o) end) - o) end",
}.items():
    _put("blend_" + _mode.lower().replace(" ", "_"), lambda c, mode=_mode: {"delta": C.blend_delta(mode, c[0], c[1] - 0.5)}, S.out(_BLEND, {"delta": f"({_e}) - o" if _mode != "Add" else "g - 0.5e0"}))
_put("master_opacity", lambda c: _rgb(x + (y - x) * 0.35 for x, y in zip(c, C.exposure(c, 1.0), strict=True)), S.out(S.steps(plates.LINE, {f"{c}2": f"{S.linear(c)} * 2e0" for c in RGB}, {f"{c}3": S.display(f"{c}2") for c in RGB}), S.rgb(lambda c: f"{c} + ({c}3 - {c}) * 0.35e0")))
_CUBE = [v for k in range(27) for v in (((k // 9) / 2) ** 2, (k // 3 % 3) / 2, 1 - (k % 3) / 2)]
_put("lut_trilinear", lambda c: _rgb(C.lut_trilinear(c, F.array(*map(F.lit, _CUBE)), 3)), S.out(S.steps(
    S.steps(plates.LINE, {f"p{c}": f"{S.clamp(c)} * 2" for c in RGB}, {f"k{c}": f"least(floor(p{c}), 1e0)::int" for c in RGB}, {f"f{c}": f"p{c} - k{c}" for c in RGB}, {"t": "[" + ", ".join(map(S.n, _CUBE)) + "]"})), {
    c: " + ".join(f"t[((kb + {db}) * 9 + (kg + {dg}) * 3 + kr + {dr}) * 3 + {i + 1}] * ({'fr' if dr else '(1 - fr)'} * {'fg' if dg else '(1 - fg)'} * {'fb' if db else '(1 - fb)'})" for db in (0, 1) for dg in (0, 1) for dr in (0, 1)) for i, c in enumerate(RGB)}))


def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure and characteristic curve, then mean and spread of the luma by image: one partial aggregate, one small shuffle."""
    c = tuple(C.characteristic_curve(x, 0.4, 0.3, 0.5) for x in C.exposure(tuple(F.col(k) for k in RGB), 0.5))
    d = plates.line(spark, sf_dir).select("image_id", C.luma(*c).alias("y"))
    return d.groupBy("image_id").agg(F.count("*").alias("pixels"), F.floor(F.avg("y") * 1e6 + 0.5).cast("bigint").alias("mean"), F.floor(F.stddev_pop("y") * 1e6 + 0.5).cast("bigint").alias("sigma"))


_G = _curve(S.steps(plates.LINE, S.rgb(lambda c: f"{S.linear(c)} * {S.n(2**0.5)}"), S.rgb(S.display)), 0.4, 0.3, 0.5)
KEPT["grade_summary"] = (grade_summary, f"select image_id, count(*) as pixels, {S.q('avg(y)')} as mean, {S.q('stddev_pop(y)')} as sigma from (select image_id, {S.luma()} as y from ({_G})) group by 1")
