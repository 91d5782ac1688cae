"""Neighbourhood operators on the long layout, an axis at a time, without self-joins.

Lines are cut into blocks of bounded length, each with as many pixels of its neighbours as the operator reaches; a row holds a
block, however long the line is, and an axis costs one exchange.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulsa.functions import colour as C

#: Pixels of a block, if the reach is no longer than that.
BLOCK = 1024
#: Taps up to which a blur is one expression; the code of longer ones is too long to be compiled well.
UNROLLED = 31


def _blocks(df: DataFrame, axis: str, keys: list[str], cols: list[str], reach: int) -> tuple[DataFrame, int]:
    """A row for each block of a line: keys, block, line (array of axis and cols, in order, with the pixels within reach of the block); and the length of blocks.

    An array ends before its block's reach only where the line does. So what is done at the ends of an array, such as reflection,
    is done at the ends of the line.
    """
    n = max(BLOCK, reach)
    at = lambda x: F.floor(x / n).cast("int")
    each = df.withColumn("block", F.explode(F.sequence(at(F.greatest(F.col(axis) - reach, F.lit(0))), at(F.col(axis) + reach)))) if reach else df.withColumn("block", at(F.col(axis)))
    lines = each.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct(axis, *cols))).alias("line"))
    # Past the end of a line there are blocks with none of their own pixels.
    return lines.filter(F.get("line", F.size("line") - 1)[axis] >= F.col("block") * n), n


def along(df: DataFrame, axis: str, cols: list[str], f, reach: int) -> DataFrame:
    """df with cols replaced by f(values of the block, place in it), lines along axis ("x" or "y"); f looks no further than reach."""
    across = "y" if axis == "x" else "x"
    rest = [c for c in df.columns if c not in (axis, across, "image_id", *cols)]
    line, n = _blocks(df, axis, ["image_id", across], [*cols, *rest], reach)
    lists = line.select("image_id", across, "block", "line", *[F.col(f"line.{c}").alias(f"all_{c}") for c in cols])
    out = lists.select("image_id", across, "block", F.posexplode("line").alias("i", "e"), *[f"all_{c}" for c in cols]).filter(F.floor(F.col(f"e.{axis}") / n) == F.col("block"))
    values = [f(F.col(f"all_{c}"), F.col("i")).alias(c) for c in cols]
    return out.select("image_id", across, F.col(f"e.{axis}").alias(axis), *[F.col(f"e.{c}").alias(c) for c in rest], *values).select(df.columns)


def taps(sigma: float, limit: int = 1 << 20) -> list[tuple[int, float]]:
    r = min(math.ceil(3 * sigma), limit)
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def _reflected(values: Column, at: Column) -> Column:
    """The value at a place, reflected at both ends, without the ends' own values, as often as it takes."""
    turn = F.greatest(2 * (F.size(values) - 1), F.lit(1))
    k = F.pmod(at, turn)
    return F.get(values, F.least(k, turn - k))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _filtered(values: Column, start: Column, count: Column, kernel: list[tuple[int, float]]) -> Column:
    """The array of the kernel's sums around each of count places from start, values reflected at both ends."""
    r, weights = kernel[-1][0], F.array(*[F.lit(w) for _, w in kernel])
    near = _let(values, lambda v: F.transform(F.sequence(start - r, start + count - 1 + r), lambda k: _reflected(v, k)))
    total = lambda v: F.aggregate(F.zip_with(v, weights, lambda a, w: a * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(count > 0, _let(near, lambda v: F.transform(F.sequence(F.lit(1), count), lambda i: total(F.slice(v, i, 2 * r + 1)))))


def _convolved(df: DataFrame, axis: str, cols: list[str], kernel: list[tuple[int, float]]) -> DataFrame:
    """along() of the kernel's sums, by arrays: the plan is as small for many taps as for few."""
    across = "y" if axis == "x" else "x"
    rest = [c for c in df.columns if c not in (axis, across, "image_id", *cols)]
    line, n = _blocks(df, axis, ["image_id", across], [*cols, *rest], kernel[-1][0])
    before = lambda end: F.size(F.filter("line", lambda e: e[axis] < end))
    start, count = F.col("start"), F.col("stop") - F.col("start")
    cut = line.select("image_id", across, "line", before(F.col("block") * n).alias("start"), before((F.col("block") + 1) * n).alias("stop"))
    own = cut.select("image_id", across, F.slice("line", start + 1, count).alias("own"), *[_filtered(F.col(f"line.{c}"), start, count, kernel).alias(f"of_{c}") for c in cols])
    # Outer: else the optimizer would compute the arrays once more, to leave out empty ones.
    out = own.select("image_id", across, F.explode_outer(F.arrays_zip("own", *[f"of_{c}" for c in cols])).alias("e")).filter("e is not null")
    return out.select("image_id", across, *[F.col(f"e.own.{c}").alias(c) for c in (axis, *rest)], *[F.col(f"e.of_{c}").alias(c) for c in cols]).select(df.columns)


def blur(df: DataFrame, cols: list[str], sigma: float, limit: int = 1 << 20) -> DataFrame:
    """Separable gaussian, reflected at the border. limit: the frame's shorter side less one."""
    if sigma < 0.05:
        return df
    kernel = taps(sigma, limit)
    if len(kernel) > UNROLLED:
        return _convolved(_convolved(df, "x", cols, kernel), "y", cols, kernel)
    f = lambda values, i: reduce(lambda a, b: a + b, [_reflected(values, i + d) * w for d, w in kernel])
    return along(along(df, "x", cols, f, kernel[-1][0]), "y", cols, f, kernel[-1][0])


# From which sigma a blur may be decimated, sigma of the small grid, longest side of a cell, sharpness of the cubic.
EXACT_TO, SMALL_SIGMA, MAX_CELL, CUBIC = 32.0, 16.0, 64, -0.75


def cubic_weights(k: int) -> list[list[tuple[int, float]]]:
    """For each pixel of a cell of k: the cells (0: its own) that a cubic through their centres takes, with weights."""
    a = CUBIC
    near, far = (lambda t: ((a + 2) * t - (a + 3)) * t * t + 1), (lambda t: a * (((t - 5) * t + 8) * t - 4))
    out = []
    for j in range(k):
        v = (j + 0.5) / k - 0.5
        base = math.floor(v)
        t = v - base
        out.append([(base - 1, far(1 + t)), (base, near(t)), (base + 1, near(1 - t)), (base + 2, far(2 - t))])
    return out


def _enlarged(small: DataFrame, axis: str, cols: list[str], k: int) -> DataFrame:
    """A grid k times as fine along axis, by cubic interpolation, held at the border."""
    across = "y" if axis == "x" else "x"
    line, n = _blocks(small, axis, ["image_id", across], cols, 2)
    lists = line.select("image_id", across, "block", "line", *[F.col(f"line.{c}").alias(f"all_{c}") for c in cols])
    cells = lists.select("image_id", across, "block", F.posexplode("line").alias("i", "e"), *[f"all_{c}" for c in cols]).filter(F.floor(F.col(f"e.{axis}") / n) == F.col("block"))
    # The few cells around a pixel are looked up once; the pixels of a cell differ in their weights only.
    held = lambda c, d: F.get(F.col(f"all_{c}"), F.least(F.greatest(F.col("i") + d, F.lit(0)), F.size(f"all_{c}") - 1))
    around = cells.select("image_id", across, F.col(f"e.{axis}").alias("cell"), *[held(c, d).alias(f"{c}_{d + 2}") for c in cols for d in range(-2, 3)])
    weights = F.array(*[F.array(*[F.lit(float(dict(row).get(d, 0.0))) for d in range(-2, 3)]) for row in cubic_weights(k)])
    fine = around.withColumn("w", F.explode(F.transform(weights, lambda w, j: F.struct(j.alias("j"), w.alias("of")))))
    value = lambda c: reduce(lambda a, b: a + b, [F.col(f"{c}_{d}") * F.get("w.of", F.lit(d)) for d in range(5)])
    return fine.select("image_id", across, (F.col("cell") * k + F.col("w.j")).cast("int").alias(axis), *[value(c).alias(c) for c in cols])


def decimated_blur(df: DataFrame, cols: list[str], sigma: float, limit: int = 1 << 20) -> DataFrame:
    """blur() for large sigmas: means of cells, a blur of those, and cubic interpolation; its cost does not grow with sigma.

    Cells lie on multiples of their side in absolute coordinates, so any part of a frame gets the same ones. A mean over a cell
    is a blur too, which the small grid's sigma leaves out. At the border the mirror is the last cell's centre, not the last pixel.
    """
    k = int(min(MAX_CELL, sigma // SMALL_SIGMA))
    if sigma <= EXACT_TO or k < 2:
        return blur(df, cols, sigma, limit)
    cell = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    small = df.groupBy("image_id", cell("y"), cell("x")).agg(*[F.avg(c).alias(c) for c in cols])
    small = blur(small, cols, math.sqrt(sigma * sigma - (k * k - 1) / 12) / k, max(1, limit // k))
    fine = _enlarged(_enlarged(small, "x", cols, k), "y", cols, k)
    return df.drop(*cols).join(fine, ["image_id", "y", "x"]).select(df.columns)


def with_blur(df: DataFrame, cols: list[str], sigma: float, suffix: str = "_b", limit: int = 1 << 20) -> DataFrame:
    """df and blurred copies of cols."""
    return blur(df.withColumns({c + suffix: F.col(c) for c in cols}), [c + suffix for c in cols], sigma, limit)


def dilate(df: DataFrame, cols: list[str], d: int) -> DataFrame:
    f = lambda values, i: F.array_max(F.slice(values, F.greatest(F.lit(1), i + 1 - d), F.least(i, F.lit(d)) + d + 1))
    return along(along(df, "x", cols, f, d), "y", cols, f, d)


def box_pool(df: DataFrame, k: int) -> DataFrame:
    return df.groupBy("image_id", F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def gradient(df: DataFrame, col: str) -> DataFrame:
    """df, gx, gy: central differences, held at the border."""
    f = lambda values, i: (F.get(values, F.least(i + 1, F.size(values) - 1)) - F.get(values, F.greatest(i - 1, F.lit(0)))) * 0.5
    df = df.withColumn("gx", F.col(col)).withColumn("gy", F.col(col))
    return along(along(df, "x", ["gx"], f, 1), "y", ["gy"], f, 1)


def unsharp(df: DataFrame, amount: float, sigma: float, limit: int = 1 << 20) -> DataFrame:
    b = with_blur(df, list("rgb"), sigma, "_b", limit)
    return b.withColumns({c: F.col(c) + (F.col(c) - F.col(f"{c}_b")) * amount for c in "rgb"}).select(df.columns)


def clarity(df: DataFrame, c: float, radius: float, limit: int = 1 << 20) -> DataFrame:
    """Local contrast of the luma; only the luma is blurred."""
    b = with_blur(df.withColumn("l", C.luma(*map(F.col, "rgb"))), ["l"], max(0.5, radius), "_b", limit)
    return b.withColumns({k: C.clamp(F.col(k) + c * (1.6 if c > 0 else 1.0) * (F.col("l") - F.col("l_b"))) for k in "rgb"}).select(df.columns)


def linear_blur(df: DataFrame, sigma: float, limit: int = 1 << 20) -> DataFrame:
    """Pre-blur and micro-blur: in linear light."""
    b = blur(df.withColumns({c: C.linear(F.col(c)) for c in "rgb"}), list("rgb"), sigma, limit)
    return b.withColumns({c: C.clamp(C.display(F.col(c))) for c in "rgb"})


def edge_magnitude(df: DataFrame, sigma: float, chroma: float, limit: int = 1 << 20) -> DataFrame:
    """df and edge."""
    if chroma <= 0.001:
        b = with_blur(df.withColumn("l", C.luma(*map(F.col, "rgb"))), ["l"], sigma, "_b", limit)
        return b.select(*df.columns, F.abs(F.col("l") - F.col("l_b")).alias("edge"))
    b = with_blur(df, list("rgb"), sigma, "_b", limit)
    hp = [F.col(c) - F.col(f"{c}_b") for c in "rgb"]
    y = F.abs(C.luma(*hp))
    return b.select(*df.columns, (y + chroma * F.greatest(F.lit(0.0), F.greatest(*[F.abs(h) for h in hp]) - y)).alias("edge"))


def edge_mask(df: DataFrame, radius: float, sensitivity: float, chroma: float, limit: int = 1 << 20) -> DataFrame:
    """df and edge in 0..1, smoothed."""
    r = max(0.3, radius)
    e = edge_magnitude(df, r, chroma, limit).withColumn("edge", C.clamp(F.col("edge") / (0.06 / max(sensitivity, 0.05))))
    return blur(e, ["edge"], 0.8 * r, limit)


def luminance_mask(df: DataFrame, p: dict[str, float], scale: float = 1.0, limit: int = 1 << 20) -> DataFrame:
    """df and m: how much grain each tone takes."""
    b = blur(df.withColumn("m", C.luma(*map(F.col, "rgb"))), ["m"], max(1.0, 3 * scale), limit)
    lo, hi, sd, hd = p["lum_low"], max(p["lum_high"], p["lum_low"] + 0.05), p["shadow_drop"], p["highlight_drop"]
    up = C.smootherstep(max(0.0, lo - max(p["shadow_falloff"], 1e-3)), lo, F.col("m"))
    down = 1 - C.smootherstep(hi, min(1.0, hi + max(p["highlight_falloff"], 1e-3)), F.col("m"))
    return b.withColumn("m", ((1 - sd) + sd * up) * ((1 - hd) + hd * down))


def halation(df: DataFrame, amount: float, radius: float, threshold: float, colour: tuple[float, float, float], limit: int = 1 << 20) -> DataFrame:
    """Light that spreads from highlights (no blue guard, no recovery)."""
    lin = df.withColumns({c: C.linear(F.col(c)) for c in "rgb"})
    t = min(threshold, 0.98)
    t = t / 12.92 if t <= 0.04045 else ((t + 0.055) / 1.055) ** 2.4
    b = blur(lin.withColumn("glow", C.clamp((C.luma(*map(F.col, "rgb")) - t) / max(1 - t, 0.02))), ["glow"], max(1.0, radius), limit)
    return b.withColumns({c: C.display(F.col(c) + F.col("glow") * (k * 0.9 * amount)) for c, k in zip("rgb", colour, strict=True)}).select(df.columns)


def isophote(df: DataFrame, col: str, sigma: float, limit: int = 1 << 20) -> DataFrame:
    """df, ty, tx, size: the tangent of lines of equal values of col, blurred, and the gradient's size, 1e-6 at least."""
    g = gradient(blur(df.withColumn("_v", F.col(col)), ["_v"], sigma, limit), "_v")
    g = g.withColumn("size", F.greatest(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.lit(1e-6)))
    return g.select(*df.columns, (F.col("gx") / F.col("size")).alias("ty"), (-F.col("gy") / F.col("size")).alias("tx"), "size")


def blue_guard(df: DataFrame, amount: float, shift: float, level: float, falloff: float) -> DataFrame:
    """Linear colours with bright blues turned by shift degrees and made stronger, so that halation leaves skies alone."""
    if amount <= 0.001 and abs(shift) <= 0.5:
        return df
    shown = df.withColumns({f"_{c}": C.display(F.col(c)) for c in "rgb"})
    own = [F.col(f"_{c}") for c in "rgb"]
    d = shown.withColumns({"_hue": C.hue(*own), "_sat": C.saturation(*own), "_y": C.luma(*own)})
    away = F.abs(F.pmod(F.col("_hue") - 230 + 180, F.lit(360.0)) - 180)
    d = d.withColumn("_m", (1 - C.smoothstep(0.0, 70.0, away)) * C.smoothstep(0.0, 0.12, F.col("_sat")) * C.smootherstep(max(0.0, level - falloff), level, F.col("_y")))
    if abs(shift) > 0.5:
        d = d.withColumns(dict(zip("rgb", C.rotate_hue(tuple(map(F.col, "rgb")), F.col("_m") * shift), strict=True)))
    if amount > 0.001:
        d = d.withColumn("_y", C.luma(*map(F.col, "rgb"))).withColumns({c: F.col("_y") + (F.col(c) - F.col("_y")) * (1 + amount * F.col("_m")) for c in "rgb"})
    return d.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in "rgb"}).select(df.columns)


def halation_stage(df: DataFrame, p: dict[str, float], colour: tuple[float, float, float], scale: float = 1.0, limit: int = 1 << 20) -> DataFrame:
    """halation() with the guard of blues and the recovery of highlights."""
    if p["halation"] <= 0.01:
        return df
    lin = df.withColumns({c: C.linear(F.col(c)) for c in "rgb"})
    t = min(p["halation_threshold"], 0.98)
    t = t / 12.92 if t <= 0.04045 else ((t + 0.055) / 1.055) ** 2.4
    b = blur(lin.withColumn("glow", C.clamp((C.luma(*map(F.col, "rgb")) - t) / max(1 - t, 0.02))), ["glow"], max(1.0, p["halation_radius"] * scale), limit)
    b = blue_guard(b, p["halation_blue"], p["halation_blue_shift"], p["halation_blue_level"], p["halation_blue_falloff"])
    b = b.withColumns({f"add_{c}": F.col("glow") * (k * 0.9 * p["halation"]) for c, k in zip("rgb", colour, strict=True)})
    if p["halation_recovery"] > 0:
        b = b.withColumns({f"head_{c}": F.greatest(1 - F.col(c), F.lit(1e-4)) for c in "rgb"})
        b = b.withColumns({f"add_{c}": F.col(f"add_{c}") * (F.col(f"head_{c}") + F.col(f"add_{c}") * (1 - p["halation_recovery"])) / (F.col(f"head_{c}") + F.col(f"add_{c}")) for c in "rgb"})
    return b.withColumns({c: C.display(F.col(c) + F.col(f"add_{c}")) for c in "rgb"}).select(df.columns)


def shifted(df: DataFrame, dy: Column, dx: Column) -> DataFrame:
    """Each pixel's colours copied from (y + dy, x + dx), held at the frame's border: an equi-join on coordinates."""
    size = df.groupBy("image_id").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    at = df.withColumns({"_dy": dy, "_dx": dx}).join(size, "image_id")
    hold = lambda v, top: F.greatest(F.lit(0), F.least(v, top)).cast("int")
    asked = at.select("image_id", "y", "x", hold(F.col("y") + F.col("_dy"), F.col("my")).alias("sy"), hold(F.col("x") + F.col("_dx"), F.col("mx")).alias("sx"))
    source = df.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "r", "g", "b")
    return asked.join(source, ["image_id", "sy", "sx"]).select("image_id", "y", "x", "r", "g", "b")
