"""Scalar functions of colour and tone as column expressions: all stay in whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]
LUMA = (0.2126, 0.7152, 0.0722)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def linear(x: Column) -> Column:
    return F.when(x < 0, 0.0).when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def display(x: Column) -> Column:
    return F.when(x < 0, 0.0).when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def smoothstep(e0: float, e1: float, x: Column) -> Column:
    if e1 - e0 < 1e-5:
        return F.when(x >= e1, 1.0).otherwise(0.0)
    t = clamp((x - e0) / (e1 - e0))
    return t * t * (3 - 2 * t)


def smootherstep(e0: float, e1: float, x: Column) -> Column:
    if e1 - e0 < 1e-5:
        return F.when(x >= e1, 1.0).otherwise(0.0)
    t = clamp((x - e0) / (e1 - e0))
    return t * t * t * (t * (6 * t - 15) + 10)


def spread(x: Column) -> Column:
    return smoothstep(0.38, 0.78, x)


def most(rgb: RGB) -> Column:
    return F.greatest(*rgb)


def least(rgb: RGB) -> Column:
    return F.least(*rgb)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees; 0 where there is no chroma."""
    top, chroma = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sector = F.when(top == r, F.pmod((g - b) / chroma, F.lit(6.0))).when(top == g, (b - r) / chroma + 2).otherwise((r - g) / chroma + 4)
    return F.when(chroma < 1e-6, 0.0).otherwise(60 * sector)


def saturation(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) - F.least(r, g, b)) / F.greatest(F.greatest(r, g, b), F.lit(1e-6))


def rotate_hue(rgb: RGB, degrees: Column) -> RGB:
    """A turn about the grey axis."""
    a = F.radians(degrees)
    c, s = F.cos(a), F.sin(a)
    mean = (rgb[0] + rgb[1] + rgb[2]) / 3
    cross = ((rgb[2] - rgb[1]), (rgb[0] - rgb[2]), (rgb[1] - rgb[0]))
    return tuple(x * c + y * s / (3**0.5) + mean * (1 - c) for x, y in zip(rgb, cross, strict=True))


def soft_knee(x: Column, amount: float, span: float) -> Column:
    if amount * span < 1e-6:
        return x
    knee = 1 - span * amount
    return F.when(x > knee, knee + (1 - knee) * F.tanh((x - knee) / (1 - knee))).otherwise(x)


def shoulder(t: Column) -> Column:
    return 1 - F.exp(-t)


def tone_roll(t: Column, a: float) -> Column:
    if a >= 0:
        return t + a * (shoulder(t) - t)
    return t + (-a) * 0.35 * smootherstep(0.0, 1.0, t) * (1 - t)


def characteristic_curve(x: Column, contrast: float, toe: float, shoulder_amount: float) -> Column:
    if contrast > 0.001:
        x = 0.46 + (x - 0.46) * (1 + 1.1 * contrast)
    if shoulder_amount > 0.001:
        x = soft_knee(x, shoulder_amount, 0.55)
    if toe > 0.001:
        x = 1 - soft_knee(1 - x, toe, 0.40)
    return x


def vibrance(rgb: RGB, v: float) -> RGB:
    y = luma(*rgb)
    sat = (most(rgb) - least(rgb)) / F.greatest(most(rgb), F.lit(1e-4))
    gain = F.greatest(F.lit(0.0), 1 + v * (1 - sat))
    return tuple(y + (c - y) * gain for c in rgb)


def saturate(rgb: RGB, s: float) -> RGB:
    y, gain = luma(*rgb), max(0.0, 1 + s)
    return tuple(y + (c - y) * gain for c in rgb)


def balance_gains(temp: float, tint: float) -> tuple[float, float, float]:
    gt, gn = 0.40 * temp, 0.30 * tint
    gains = (1 + gt + gn, 1 - gn, 1 - gt + gn)
    y = sum(w * g for w, g in zip(LUMA, gains, strict=True))
    return tuple(g / y for g in gains)


def white_balance(rgb: RGB, temp: float, tint: float) -> RGB:
    return tuple(display(linear(c) * g) for c, g in zip(rgb, balance_gains(temp, tint), strict=True))


def exposure(rgb: RGB, ev: float) -> RGB:
    return tuple(display(linear(c) * 2.0**ev) for c in rgb)


def shadows_highlights(rgb: RGB, shadows: float, highlights: float) -> RGB:
    v = most(rgb)
    out = v
    if abs(highlights) > 0.001:
        t = F.greatest(F.lit(0.0), (v - 0.5) / 0.5)
        out = F.when(v > 0.5, 0.5 + 0.5 * tone_roll(t, -highlights)).otherwise(out)
    if abs(shadows) > 0.001:
        t = F.greatest(F.lit(0.0), (0.5 - v) / 0.5)
        out = F.when(v < 0.5, 0.5 - 0.5 * tone_roll(t, shadows)).otherwise(out)
    ratio = out / F.greatest(v, F.lit(1e-4))
    return tuple(clamp(c * ratio) for c in rgb)


def contrast(x: Column, c: float) -> Column:
    return clamp(0.46 + (x - 0.46) * max(0.0, 1 + 0.9 * c))


def black_point(x: Column, b: float) -> Column:
    return clamp((x - b) / max(1 - b, 1e-4))


def warmth_axis() -> tuple[float, float, float]:
    y = LUMA[0] * 1 + LUMA[1] * 0.15 + LUMA[2] * -1
    axis = (1 - y, 0.15 - y, -1 - y)
    top = max(map(abs, axis))
    return tuple(0.14 * a / top for a in axis)


def tone_steps(p: dict[str, float]) -> list:
    """The tone response as steps of colour to colour: brightness, curve, highlight desaturation, vibrance, warmth, base fog; clamped.

    Each step uses its input several times, so they are meant to be put into a DataFrame one after the other (see
    operators.points.through): nested, their expressions would multiply.
    """
    each = lambda f: lambda rgb: tuple(f(c) for c in rgb)
    steps = []
    if abs(p["brightness"]) > 0.001:
        steps += [lambda rgb: tuple(linear(c) * 2.0 ** p["brightness"] for c in rgb), each(display)]
    if p["contrast"] > 0.001:
        steps.append(each(lambda x: 0.46 + (x - 0.46) * (1 + 1.1 * p["contrast"])))
    if p["shoulder"] > 0.001:
        steps.append(each(lambda x: soft_knee(x, p["shoulder"], 0.55)))
    if p["toe"] > 0.001:
        steps.append(each(lambda x: 1 - soft_knee(1 - x, p["toe"], 0.40)))
    if p["highlight_desat"] > 0.001:

        def desaturate(rgb: RGB) -> RGB:
            y = luma(*rgb)
            w = smoothstep(0.62, 1.0, y) * p["highlight_desat"]
            return tuple(c + w * (y - c) for c in rgb)

        steps.append(desaturate)
    if abs(p["vibrance"]) > 0.001:
        steps.append(lambda rgb: vibrance(rgb, p["vibrance"]))
    if abs(p["highlight_warmth"]) > 0.001 or abs(p["shadow_warmth"]) > 0.001:

        def warm(rgb: RGB) -> RGB:
            y = luma(*rgb)
            w = smoothstep(0.30, 0.85, y) * p["highlight_warmth"] + (1 - smoothstep(0.15, 0.70, y)) * p["shadow_warmth"]
            return tuple(c + a * w for c, a in zip(rgb, warmth_axis(), strict=True))

        steps.append(warm)
    if p["base_fog"] > 0:
        steps.append(each(lambda c: p["base_fog"] + (1 - p["base_fog"]) * c))
    return [*steps, each(clamp)]


def grade_steps(p: dict[str, float]) -> list:
    """The point operators of the colour grading section, in order (recovery and clarity are neighbourhood operators)."""
    each = lambda f: lambda rgb: tuple(f(c) for c in rgb)
    steps = []
    if abs(p["grade_temp"]) > 0.001 or abs(p["grade_tint"]) > 0.001:
        steps.append(lambda rgb: white_balance(rgb, p["grade_temp"], p["grade_tint"]))
    if abs(p["grade_exposure"]) > 0.001:
        steps.append(lambda rgb: exposure(rgb, p["grade_exposure"]))
    if abs(p["grade_shadows"]) > 0.001 or abs(p["grade_highlights"]) > 0.001:
        steps.append(lambda rgb: shadows_highlights(rgb, p["grade_shadows"], p["grade_highlights"]))
    steps.append(each(clamp))
    if abs(p["grade_contrast"]) > 0.001:
        steps.append(each(lambda x: contrast(x, p["grade_contrast"])))
    if p["grade_black_point"] > 0.001:
        steps.append(each(lambda x: black_point(x, p["grade_black_point"])))
    if abs(p["grade_vibrance"]) > 0.001:
        steps += [lambda rgb: vibrance(rgb, p["grade_vibrance"]), each(clamp)]
    if abs(p["grade_saturation"]) > 0.001:
        steps += [lambda rgb: saturate(rgb, p["grade_saturation"]), each(clamp)]
    return steps


def lut_trilinear(rgb: RGB, table: Column, size: int, dmin=(0.0, 0.0, 0.0), dmax=(1.0, 1.0, 1.0)) -> RGB:
    """Three-way interpolation in a table (an array column of size ** 3 * 3 values, red fastest)."""
    at = [clamp((c - lo) / (hi - lo)) * (size - 1) for c, lo, hi in zip(rgb, dmin, dmax, strict=True)]
    base = [F.least(F.floor(x), F.lit(size - 2)).cast("int") for x in at]
    frac = [x - k for x, k in zip(at, base, strict=True)]

    def corner(k: int, dr: int, dg: int, db: int) -> Column:
        index = ((base[2] + db) * size + base[1] + dg) * size + base[0] + dr
        w = reduce(lambda a, b: a * b, [f if d else 1 - f for f, d in zip(frac, (dr, dg, db), strict=True)])
        return F.get(table, index * 3 + k) * w

    corners = [(dr, dg, db) for db in (0, 1) for dg in (0, 1) for dr in (0, 1)]
    return tuple(reduce(lambda a, b: a + b, [corner(k, *c) for c in corners]) for k in range(3))


def blend_delta(mode: str, base: Column, g: Column) -> Column:
    """What a layer of signed noise g adds to base under a blend mode."""
    if mode == "Add":
        return g
    b = clamp(base)
    layer = g * 0.5 + 0.5
    dodge = 1 - 2 * (1 - b) * (1 - layer)
    if mode == "Multiply":
        out = b * layer
    elif mode == "Screen":
        out = 1 - (1 - b) * (1 - layer)
    elif mode == "Overlay":
        out = F.when(b <= 0.5, 2 * b * layer).otherwise(dodge)
    elif mode == "Hard Light":
        out = F.when(layer <= 0.5, 2 * b * layer).otherwise(dodge)
    else:  # Soft Light, as the web's compositing standard has it
        d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
        out = F.when(layer <= 0.5, b - (1 - 2 * layer) * b * (1 - b)).otherwise(b + (2 * layer - 1) * (d - b))
    return out - b


def source_masks(rgb: RGB, pivot: float) -> tuple[Column, Column, Column, Column]:
    r, g, b = rgb
    over = lambda x, y, z: F.greatest(F.lit(0.0), x - F.greatest(y, z))
    p = min(0.98, max(0.02, pivot))
    y = clamp(luma(*rgb))
    tri = clamp(F.when(y < p, y / p).otherwise((1 - y) / (1 - p)))
    return over(r, g, b), over(g, r, b), over(b, r, g), tri * tri * (3 - 2 * tri)
