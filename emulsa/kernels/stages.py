"""The pipeline of stages on one padded tile. Each reads parameters p, the working scale and absolute coordinates only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from . import marks
from .noise import cell_noise, fbm, grain_points, smoothed
from .primitives import LUMA, blur, box_pool, clamp, display, edge_magnitude, f32, hsv_to_rgb, hue_sat, isophote, linear, luma, resample, rotate_hue, ss, sss, warp

AMPLITUDE = 0.38
# Seeds of the five layers of global grain; and by scatter pattern first angle, count of directions, diamond, inner radius, short spokes.
LAYER_SEEDS = ((7717, 3391), (11003, 12007), (13009, 14011), (15013, 16033), (17011, 18013))
STENCILS = ((0, 0, False, 0, 1), (0, 4, False, 0, 1), (45, 4, False, 0, 1), (0, 8, False, 0, 1), (0, 0, True, 0, 1), (0, 0, False, 0.65, 1), (0, 8, False, 0, 0.4), (0, 2, False, 0, 1), (90, 2, False, 0, 1))
LAYERS = ("global_intensity", "global_src_r", "global_src_g", "global_src_b", "global_src_l")


@dataclass
class Place:
    """Where a tile lies: its origin and the frame's size in working pixels, and the working scale."""

    y0: int = 0
    x0: int = 0
    frame_h: int = 0
    frame_w: int = 0
    scale: float = 1.0
    lut: dict | None = None
    meter: dict = field(default_factory=dict)


def roll(t: np.ndarray, a: float) -> np.ndarray:
    return t + a * (1 - np.exp(-t) - t) if a >= 0 else t - a * 0.35 * sss(0, 1, t) * (1 - t)


def normalize(x: np.ndarray, p: dict, m: dict) -> np.ndarray:
    if p["normalize"] < 0.5 or not m:
        return x
    source, white = x, m["norm_white"]
    gains = np.array([m["norm_gain_r"], m["norm_gain_g"], m["norm_gain_b"]], f32)
    if m["norm_ev"] != 0 or (gains != 1).any() or white != 1:
        lin = linear(x) * (gains * f32(2.0 ** m["norm_ev"]))[:, None, None]
        if white > 1:
            v = lin.max(axis=0)
            lin = lin * (v * (1 + v / white**2) / (1 + v) / np.maximum(v, 1e-6))
        x = display(lin)
    if m["norm_toe"] > 0.001:
        v = x.max(axis=0)
        u = np.maximum(0, (0.06 - v) / 0.06)
        x = x * (np.where(v < 0.06, 0.06 - 0.06 * roll(u, m["norm_toe"]), v) / np.maximum(v, 1e-4))
    if p["highlight_priority"] > 0.001:
        x = x + (source - x) * ss(0.15, 1.0, source.max(axis=0)) * p["highlight_priority"]
    return clamp(x)


def _dilate(x: np.ndarray, d: int) -> np.ndarray:
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (d, d)
        x = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, constant_values=-np.inf), 2 * d + 1, axis).max(axis=-1)
    return x


def reconstruct(x: np.ndarray, p: dict, s: float) -> np.ndarray:
    """Clipped channels estimated from what their surroundings have in the channels that are not."""
    if p["grade_recover"] <= 0.001:
        return x
    r = max(1.0, p["grade_recover_radius"] * s)
    clipped = ss(0.94, 0.999, x)
    valid = 1 - clipped
    clean = valid.min(axis=0)
    den = blur(clean, r)
    q = blur(x * clean, r) / np.maximum(den, 1e-3)
    evidence = ss(0, 0.02, den)
    k = q / np.maximum(luma(q), 1e-4)
    w = LUMA[:, None, None] * valid
    guide = (w * x).sum(axis=0) / np.maximum((w * k).sum(axis=0), 1e-4)
    weight = p["grade_recover"] * clipped * evidence
    out = x + weight * np.maximum(0, np.clip(k * guide, 0, 4) - x)
    rg = max(1, round(0.25 * r))
    gate = blur(_dilate(weight.max(axis=0), 2 * rg), rg)
    t = (out - 0.8) / 0.2
    return np.where(out > 0.8, 0.8 + 0.2 * (t + gate * (1 - np.exp(-np.maximum(t, 0)) - t)), out).astype(f32)


def vibrance(x: np.ndarray, v: float) -> np.ndarray:
    y, top, low = luma(x), x.max(axis=0), x.min(axis=0)
    return y + (x - y) * np.maximum(0, 1 + v * (1 - (top - low) / np.maximum(top, 1e-4)))


def apply_lut(x: np.ndarray, lut: dict) -> np.ndarray:
    n, t = lut["size"], np.asarray(lut["table"], f32).reshape(lut["size"], lut["size"], lut["size"], 3)
    at = [np.clip((c - lo) / (hi - lo), 0, 1) * (n - 1) for c, lo, hi in zip(x, lut["dmin"], lut["dmax"], strict=True)]
    base = [np.minimum(a.astype(int), n - 2) for a in at]
    fr, fg, fb = [(a - k)[..., None] for a, k in zip(at, base, strict=True)]
    kr, kg, kb = base
    edge = lambda db, dg: t[kb + db, kg + dg, kr] * (1 - fr) + t[kb + db, kg + dg, kr + 1] * fr
    out = (edge(0, 0) * (1 - fg) + edge(0, 1) * fg) * (1 - fb) + (edge(1, 0) * (1 - fg) + edge(1, 1) * fg) * fb
    return np.moveaxis(out, -1, 0).astype(f32)


def grade(x: np.ndarray, p: dict, at: Place) -> np.ndarray:
    s = at.scale
    x = reconstruct(x, p, s)
    if abs(p["grade_temp"]) > 0.001 or abs(p["grade_tint"]) > 0.001:
        gt, gn = 0.40 * p["grade_temp"], 0.30 * p["grade_tint"]
        gains = np.array([1 + gt + gn, 1 - gn, 1 - gt + gn], f32)
        x = display(linear(x) * (gains / (LUMA * gains).sum())[:, None, None])
    if abs(p["grade_exposure"]) > 0.001:
        x = display(linear(x) * f32(2.0 ** p["grade_exposure"]))
    if abs(p["grade_shadows"]) > 0.001 or abs(p["grade_highlights"]) > 0.001:
        v = x.max(axis=0)
        new = v
        if abs(p["grade_highlights"]) > 0.001:
            new = np.where(v > 0.5, 0.5 + 0.5 * roll(np.maximum(0, (v - 0.5) / 0.5), -p["grade_highlights"]), new)
        if abs(p["grade_shadows"]) > 0.001:
            new = np.where(v < 0.5, 0.5 - 0.5 * roll(np.maximum(0, (0.5 - v) / 0.5), p["grade_shadows"]), new)
        x = x * (new / np.maximum(v, 1e-4))
    x = clamp(x)
    if abs(p["grade_contrast"]) > 0.001:
        x = clamp(0.46 + (x - 0.46) * max(0.0, 1 + 0.9 * p["grade_contrast"]))
    if p["grade_black_point"] > 0.001:
        x = clamp((x - p["grade_black_point"]) / max(1 - p["grade_black_point"], 1e-4))
    if abs(c := p["grade_clarity"]) > 0.001:
        y = luma(x)
        x = clamp(x + c * (1.6 if c > 0 else 1) * (y - blur(y, max(0.5, p["grade_clarity_radius"] * s))))
    if abs(p["grade_vibrance"]) > 0.001:
        x = clamp(vibrance(x, p["grade_vibrance"]))
    if abs(p["grade_saturation"]) > 0.001:
        y = luma(x)
        x = clamp(y + (x - y) * max(0.0, 1 + p["grade_saturation"]))
    if at.lut and p["lut_amount"] > 0.001:
        new = clamp(apply_lut(x, at.lut))
        x = new if p["lut_amount"] >= 0.999 else x + (new - x) * p["lut_amount"]
    return x.astype(f32)


def _knee(x: np.ndarray, amount: float, span: float) -> np.ndarray:
    knee = 1 - span * amount
    return np.where(x > knee, knee + (1 - knee) * np.tanh((x - knee) / max(1 - knee, 1e-6)), x)


def tone(x: np.ndarray, p: dict) -> np.ndarray:
    if abs(p["brightness"]) > 0.001:
        x = display(linear(x) * f32(2.0 ** p["brightness"]))
    if p["contrast"] > 0.001:
        x = 0.46 + (x - 0.46) * (1 + 1.1 * p["contrast"])
    if p["shoulder"] > 0.001:
        x = _knee(x, p["shoulder"], 0.55)
    if p["toe"] > 0.001:
        x = 1 - _knee(1 - x, p["toe"], 0.40)
    if p["highlight_desat"] > 0.001:
        y = luma(x)
        x = x + ss(0.62, 1.0, y) * p["highlight_desat"] * (y - x)
    if abs(p["vibrance"]) > 0.001:
        x = vibrance(x, p["vibrance"])
    if abs(p["highlight_warmth"]) > 0.001 or abs(p["shadow_warmth"]) > 0.001:
        y = luma(x)
        axis = np.array([1, 0.15, -1], f32)
        axis -= (LUMA * axis).sum()
        axis *= 0.14 / np.abs(axis).max()
        x = x + axis[:, None, None] * (ss(0.30, 0.85, y) * p["highlight_warmth"] + (1 - ss(0.15, 0.70, y)) * p["shadow_warmth"])
    if p["base_fog"] > 0:
        x = p["base_fog"] + (1 - p["base_fog"]) * x
    return clamp(x).astype(f32)


def _lay(shape: tuple, at: Place) -> tuple[int, int, int, int]:
    return at.y0, at.x0, shape[-2], shape[-1]


def grain_field(shape: tuple, p: dict, at: Place, shade: np.ndarray) -> np.ndarray:
    cell, seed, octaves = max(0.8, p["grain_size"] * at.scale), int(p["seed"]), round(p["octaves"])
    n = fbm(*_lay(shape, at), cell, seed, 3, octaves, p["roughness"])
    if p["shadow_size"] > 0.02:
        big = fbm(*_lay(shape, at), cell * (1 + 1.2 * p["shadow_size"]), seed + 5077, 3, max(1, octaves - 1), p["roughness"])
        n = n + (big - n) * (p["shadow_size"] * (1 - ss(0, 0.6, shade)))
    t = 2 * n - 1
    mono = t.mean(axis=0) * f32(math.sqrt(3))
    g = np.clip((mono + p["chroma_grain"] * (t - mono)) / 0.55, -1, 1)
    return (np.sign(g) * np.maximum(np.abs(g), 1e-6) ** (1 - 0.75 * p["clump"])).astype(f32)


def antialias(lin: np.ndarray, p: dict, s: float) -> np.ndarray:
    if p["aa_strength"] <= 0.001:
        return lin
    r = max(0.2, p["aa_radius"] * s)
    for k in range(min(3, math.ceil(p["aa_strength"]))):
        amount = min(1.0, p["aa_strength"] - k)
        y = luma(display(lin))
        ty, tx, size = isophote(y, max(0.7, 0.5 * r))
        m = ss(0, 0.012, size)
        if p["aa_edge_only"] > 0:
            hard = blur(ss(0.03, 0.11, np.abs(y - blur(y, r))), 0.6 * r)
            m = m * ((1 - p["aa_edge_only"]) + p["aa_edge_only"] * hard)
        mean = sum(w * (lin if d == 0 else warp(lin, ty * f32(d * r), tx * f32(d * r))) for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)))
        lin = lin + (mean - lin) * (amount * m)
    return lin


def scatter(lin: np.ndarray, p: dict, at: Place) -> np.ndarray:
    """Pixels moved whole, in directions of a pattern."""
    if p["scatter"] <= 0.001:
        return lin
    reach, cell = max(0.5, p["scatter_radius"] * at.scale), max(1.0, p["scatter_cell"] * at.scale)
    pick, far, gate = cell_noise(*_lay(lin.shape, at), cell, int(p["seed"]) + 3301, 3)
    dx, dy = scatter_offsets(pick, far, reach, p["scatter_spread"], round(p["scatter_pattern"]))
    move = gate < p["scatter"]
    return warp(lin, np.where(move, dy, 0), np.where(move, dx, 0), nearest=True)


def scatter_offsets(pick: np.ndarray, far: np.ndarray, reach: float, spread: float, pattern: int) -> tuple[np.ndarray, np.ndarray]:
    first, count, diamond, inner, short = STENCILS[pattern]
    if count:
        k = np.clip(np.floor(pick * count), 0, count - 1)
        theta, spoke = math.radians(first) + k * (2 * math.pi / count), np.where(k % 2 < 0.5, 1, short)
    else:
        theta, spoke = pick * (2 * math.pi), 1
    c, s = np.cos(theta), np.sin(theta)
    shape = 1 / np.maximum(np.abs(c) + np.abs(s), 1e-4) if diamond else 1
    r = reach * (inner + (1 - inner) * (1 - spread * far)) * shape * spoke
    return np.rint(r * c), np.rint(r * s)


def blue_guard(lin: np.ndarray, p: dict) -> np.ndarray:
    amount, shift = p["halation_blue"], p["halation_blue_shift"]
    if amount <= 0.001 and abs(shift) <= 0.5:
        return lin
    shown = display(lin)
    h, sat = hue_sat(shown)
    d = np.abs(np.mod(h - 230 + 180, 360) - 180)
    level = p["halation_blue_level"]
    m = (1 - ss(0, 70, d)) * ss(0, 0.12, sat) * sss(max(0.0, level - p["halation_blue_falloff"]), level, luma(shown))
    if abs(shift) > 0.5:
        lin = rotate_hue(lin, m * f32(shift))
    if amount > 0.001:
        y = luma(lin)
        lin = y + (lin - y) * (1 + f32(amount) * m)
    return np.maximum(lin, 0)


def halation(x: np.ndarray, p: dict, s: float) -> np.ndarray:
    if p["halation"] <= 0.01:
        return x
    lin = linear(x)
    threshold = float(linear(np.array(min(p["halation_threshold"], 0.98), f32)))
    glow = blur(clamp((luma(lin) - threshold) / max(1 - threshold, 0.02)), max(1.0, p["halation_radius"] * s))
    lin = blue_guard(lin, p)
    colour = np.array(hsv_to_rgb(p["halation_hue"], p["halation_sat"], 1.0), f32)[:, None, None]
    add = glow * colour * f32(0.9 * p["halation"])
    if p["halation_recovery"] > 0:
        head = np.maximum(1 - lin, 1e-4)
        add = add * (head + add * (1 - p["halation_recovery"])) / (head + add)
    return display(lin + add)


def sand(x: np.ndarray, p: dict, s: float, edge: np.ndarray) -> np.ndarray:
    if p["edge_sand"] <= 0.01:
        return x
    total = max(0.5, p["edge_sand_grit"] * s)
    passes = min(3, max(1, round(total / 1.2)))
    r = total / passes
    for _ in range(passes):
        ty, tx, size = isophote(luma(x), max(0.6, 0.6 * r))
        taps = ((-2, 0.054), (-1, 0.242), (0, 0.399), (1, 0.242), (2, 0.054))
        mean = sum(w * (x if d == 0 else warp(x, ty * f32(d * r), tx * f32(d * r))) for d, w in taps) / f32(sum(w for _, w in taps))
        x = x + (mean - x) * edge * ss(0, 0.012, size) * min(p["edge_sand"], 1.0)
    return x


def jitter(x: np.ndarray, p: dict, at: Place, edge: np.ndarray) -> np.ndarray:
    if p["edge_jitter"] <= 0.01:
        return x
    d = 2 * fbm(*_lay(x.shape, at), max(0.8, 3 * p["grain_size"] * at.scale), int(p["seed"]) + 911, 2, 1, 0.5) - 1
    dx, dy = d[0], d[1]
    if p["jitter_aniso"] > 0.01:
        c, s = math.cos(math.radians(p["jitter_angle"])), math.sin(math.radians(p["jitter_angle"]))
        u, v = dx * c + dy * s, (dy * c - dx * s) * (1 - p["jitter_aniso"])
        dx, dy = u * c - v * s, u * s + v * c
    k = 3 * p["edge_jitter"] * max(at.scale, 0.25) * edge
    return warp(x, dy * k, dx * k)


def masks(x: np.ndarray, p: dict, s: float) -> tuple[np.ndarray, ...]:
    """Density luma, reference luma, edge mask, response mask, texture guard."""
    dens = luma(tone(x, p))
    smooth = blur(dens, max(1.0, 3 * s))
    lo, hi = p["lum_low"], max(p["lum_high"], p["lum_low"] + 0.05)
    up = sss(max(0.0, lo - max(p["shadow_falloff"], 1e-3)), lo, smooth)
    down = 1 - sss(hi, min(1.0, hi + max(p["highlight_falloff"], 1e-3)), smooth)
    sd, hd = p["shadow_drop"], p["highlight_drop"]
    response = ((1 - sd) + sd * up) * ((1 - hd) + hd * down)
    ref = luma(antialias(x, p, s)) if p["aa_strength"] > 0.001 else luma(x)
    r = max(0.3, p["highpass_radius"] * s)
    edge = blur(clamp(edge_magnitude(x, r, p["edge_chroma_sense"]) / (0.06 / max(p["edge_sensitivity"], 0.05))), 0.8 * r)
    guard = f32(1)
    if p["smooth_guard"] > 0.01:
        rr = max(1.0, 2.5 * r)
        texture = blur(np.abs(ref - blur(ref, rr)), rr)
        guard = (1 - p["smooth_guard"]) + p["smooth_guard"] * ss(0.002, 0.015, texture)
    return dens, ref, edge, response, guard


def structure(base: np.ndarray, p: dict, at: Place) -> np.ndarray:
    """Grain and edge destruction, from the masks of the graded frame."""
    s = at.scale
    dens, _, edge, response, guard = masks(base, p, s)
    r = max(0.3, p["highpass_radius"] * s)
    g = grain_field(base.shape, p, at, dens) if p["intensity"] > 0 or p["edge_erosion"] > 0.01 else np.zeros_like(base)
    weight = response * ((1 - p["edge_bias"]) + p["edge_bias"] * edge) * guard
    out = base + g * weight * f32(p["intensity"] / 100 * AMPLITUDE)
    if p["edge_soften"] > 0.01:
        sr, sel = max(0.3, p["edge_soften_radius"] * s), p["edge_soften_edges_only"]
        hard = blur(ss(0.03 * sel, 0.11 * sel, edge_magnitude(out, sr, p["edge_chroma_sense"])), 0.6 * sr)
        out = out + (blur(out, sr) - out) * hard * p["edge_soften"]
    clean = edge
    if p["edge_jitter"] > 0.01:
        edge = edge * (0.55 + 0.9 * fbm(*_lay(base.shape, at), max(0.8, 2 * p["grain_size"] * s), int(p["seed"]) + 4241, 1, 2, 0.6)[0])
    out = jitter(out, p, at, edge)
    out = sand(out, p, s, clean)
    soft = p["micro_blur"] * s
    if p["scatter"] > 0.001 or soft >= 0.05:
        out = clamp(display(blur(scatter(linear(out), p, at), soft)))
    if p["edge_erosion"] > 0.01:
        mean = g.mean(axis=0)
        out = out + (mean + p["edge_chroma"] * (g - mean)) * (base - blur(base, r)) * weight * f32(1.6 * p["edge_erosion"])
    if p["acutance"] > 0.01:
        out = out + (base - blur(base, 1.5 * r)) * f32(0.35 * p["acutance"])
    if p["aa_strength"] > 0.001:
        out = display(antialias(linear(out), p, s))
    return out.astype(f32)


def blend_delta(base: np.ndarray, g: np.ndarray, mode: int) -> np.ndarray:
    if mode == 0:
        return g
    b, layer = clamp(base), g * f32(0.5) + f32(0.5)
    dodge = 1 - 2 * (1 - b) * (1 - layer)
    if mode == 1:
        return np.where(b <= 0.5, 2 * b * layer, dodge) - b
    if mode == 2:
        d = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
        return np.where(layer <= 0.5, -(1 - 2 * layer) * b * (1 - b), (2 * layer - 1) * (d - b))
    if mode == 3:
        return np.where(layer <= 0.5, 2 * b * layer, dodge) - b
    return b * layer - b if mode == 4 else 1 - (1 - b) * (1 - layer) - b


def source_masks(x: np.ndarray, pivot: float) -> list[np.ndarray]:
    r, g, b = x
    pivot = min(max(pivot, 0.02), 0.98)
    d = luma(x) - pivot
    t = clamp(1 - np.where(d < 0, -d / pivot, d / (1 - pivot)))
    return [np.maximum(0, r - np.maximum(g, b)), np.maximum(0, g - np.maximum(r, b)), np.maximum(0, b - np.maximum(r, g)), t * t * (3 - 2 * t)]


def global_cells(p: dict, s: float) -> tuple[float, float]:
    lo = max(0.8, p["global_size"] * s)
    return lo, max(lo, p["global_size_max"] * s)


def global_field(shape: tuple, p: dict, at: Place, layer: int) -> np.ndarray:
    lo, hi = global_cells(p, at.scale)
    seed = int(p["seed"]) + int(p["global_seed"])
    make = lambda k, fields: np.clip((2 * smoothed(grain_points(*_lay(shape, at), lo, hi, seed + LAYER_SEEDS[layer][k], fields, p["global_mottle"]), p["global_smooth"], lo, hi) - 1) / f32(0.55), -1, 1)
    mono = make(0, 1)
    c = p["global_chroma"]
    if c <= 0.001:
        return np.repeat(mono, 3, axis=0)
    x = make(1, 3)
    return mono * f32(math.sqrt(1 - 2 * c / 3)) + (x - x.mean(axis=0)) * f32(math.sqrt(c))


def global_grain(x: np.ndarray, p: dict, at: Place) -> np.ndarray:
    if p["global_opacity"] <= 0.001 or all(p[k] <= 0.01 for k in LAYERS):
        return x
    masks_ = [f32(1), *source_masks(clamp(x), p["global_src_l_pivot"])]
    for k, name in enumerate(LAYERS):
        if p[name] > 0.01:
            x = x + blend_delta(x, global_field(x.shape, p, at, k), round(p["global_blend"])) * (f32(p[name] / 100 * AMPLITUDE * p["global_opacity"]) * masks_[k])
    return x


def _graded(x: np.ndarray, p: dict, at: Place) -> np.ndarray:
    s = at.scale
    x = grade(x, p, at)
    if p["pre_blur"] * s >= 0.05:
        x = clamp(display(blur(linear(x), p["pre_blur"] * s)))
    if p["pre_sharpen"] > 0.01:
        x = clamp(x + (x - blur(x, max(0.3, p["pre_sharpen_radius"] * s))) * p["pre_sharpen"])
    return x.astype(f32)


def _finished(x: np.ndarray, p: dict, at: Place) -> np.ndarray:
    s = at.scale
    x = tone(halation(x, p, s), p)
    x = marks.film_texture(x, p, at)
    x = global_grain(x, p, at)
    if p["sharpen"] > 0.01:
        x = x + (x - blur(x, max(0.3, p["sharpen_radius"] * s))) * p["sharpen"]
    return clamp(x).astype(f32)


#: All stages, in order. Between two parts the picture is all that later stages read, so it can be kept there.
PARTS = (lambda x, p, at: normalize(x, p, at.meter), _graded, structure, _finished)
#: The section that begins after each part but the last.
BOUNDARIES = ("Colour Grading", "Grain Structure", "Halation")


def render(x: np.ndarray, p: dict, at: Place, first: int = 0, last: int = len(PARTS)) -> np.ndarray:
    """Parts first to last - 1 on one padded tile of the working frame."""
    for part in PARTS[first:last]:
        x = part(x, p, at)
    return x


def working_shape(h: int, w: int, supersample: float) -> tuple[int, int]:
    return max(1, round(h * supersample)), max(1, round(w * supersample))


def enlarged(x: np.ndarray, supersample: float) -> np.ndarray:
    """A tile on the working grid."""
    return x if supersample == 1 else clamp(resample(x, *working_shape(*x.shape[-2:], supersample), False))


def working_place(at: Place, h: int, supersample: float) -> Place:
    """at, of a tile of so many rows, in working pixels."""
    if supersample == 1:
        return at
    k = working_shape(h, 1, supersample)[0] / h
    return Place(round(at.y0 * k), round(at.x0 * k), round(at.frame_h * k), round(at.frame_w * k), at.scale * k, at.lut, at.meter)


def reduced(fine: np.ndarray, x: np.ndarray, p: dict, supersample: float) -> np.ndarray:
    """A rendered tile on the grid of its source x, then the master opacity."""
    if supersample == 1:
        out = fine
    elif supersample == int(supersample):
        out = box_pool(fine, int(supersample))
    else:
        out = clamp(resample(fine, *x.shape[-2:], supersample > 1, "linear" if supersample > 1 else "cubic"))
    return out if p["master_opacity"] >= 1 else x + (out - x) * f32(p["master_opacity"])


def render_supersampled(x: np.ndarray, p: dict, at: Place, supersample: float) -> np.ndarray:
    """render() on a finer or coarser grid and back; at is in pixels of x."""
    if p["master_opacity"] <= 0:
        return x
    return reduced(render(enlarged(x, supersample), p, working_place(at, x.shape[-2], supersample)), x, p, supersample)
