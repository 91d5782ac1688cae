"""Drawn marks: light leaks, scratches, hair, dust.

The random numbers of all marks of a kind are one array, a row a mark; columns of it become columns of pixel geometry, and a
tile draws the rows whose reach meets it. Nothing depends on the tile but the coordinates at which the shapes are evaluated,
and a mark's row doesn't depend on how many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from .noise import value_noise
from .primitives import blur, clamp, display, f32, linear, ss

# The placement sequence's ratio, and quantiles of the value-noise field by the fraction of points above them.
PLASTIC = 1.32471795724474602596
QUANTILES = (
    (0.30, 0.6342), (0.20, 0.7147), (0.12, 0.7900), (0.07, 0.8444), (0.04, 0.8829), (0.02, 0.9164), (0.01, 0.9422), (0.005, 0.9616), (0.002, 0.9792), (0.001, 0.9878),
    (5e-4, 0.9933), (2e-4, 0.9970), (1e-4, 0.9985), (5e-5, 0.9993), (2e-5, 0.9996), (1e-5, 0.999822), (5e-6, 0.999913), (2e-6, 0.999960), (1e-6, 0.999977), (5e-7, 0.999986),
)
LEAK_SALT, DUST_SALT, HAIR_SALT = 0, 5501, 6607
MAX_LEAKS, MAX_DUST, MAX_HAIR = 64, 4000, 400


def threshold(fraction: float) -> float:
    """The value that so small a fraction of the field lies above."""
    x = [math.log(f) for f, _ in reversed(QUANTILES)]
    return float(np.interp(math.log(min(max(fraction, 5e-7), 0.30)), x, [q for _, q in reversed(QUANTILES)]))


TURN = 2 * math.pi
GOLDEN = 0.6180339887498949


def generator(seed: int, salt: int, k: int) -> np.random.Generator:
    return np.random.default_rng((seed & 0xFFFF) * 1_000_003 + salt + 7919 * k + 17)


def draws(seed: int, salt: int, n: int, width: int) -> np.ndarray:
    """Uniform numbers, a row for each mark."""
    return np.array([generator(seed, salt, k).random(width) for k in range(n)]).reshape(n, width)


def scattered(u: np.ndarray, seed: int, salt: int) -> np.ndarray:
    """Places (rows of y, x in shares of the frame): a low-discrepancy sequence, jittered by the first two draws."""
    step = np.arange(1, len(u) + 1)[:, None] * [PLASTIC**-2, PLASTIC**-1]
    return (generator(seed, salt + 977, 0).random(2) + step + 0.06 * (u[:, :2] - 0.5)) % 1


def within(size: tuple[int, int], at, centre: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, tuple[slice, slice], np.ndarray, np.ndarray]]:
    """Of each mark that meets a tile: its row, the part of the tile within reach of its centre, and distances from it along y and x."""
    origin, size = np.array([at.y0, at.x0]), np.array(size)
    lo = np.maximum(0, np.floor(centre - reach[:, None]) - origin).astype(int)
    hi = np.minimum(size, np.ceil(centre + reach[:, None]) + 1 - origin).astype(int)
    for k in np.flatnonzero((lo < hi).all(axis=1)):
        (a, c), (b, d) = lo[k], hi[k]
        yield k, (slice(a, b), slice(c, d)), (np.arange(a, b) + at.y0 - centre[k, 0])[:, None], (np.arange(c, d) + at.x0 - centre[k, 1])[None, :]


def rotated(dy: np.ndarray, dx: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances along an axis and across it."""
    return dx * math.cos(angle) + dy * math.sin(angle), dy * math.cos(angle) - dx * math.sin(angle)


def paint(x: np.ndarray, part: tuple[slice, slice], colour: float, alpha: np.ndarray) -> None:
    x[:, *part] += alpha * (colour - x[:, *part])


def leak_columns(seed: int, n: int, variation: float) -> dict[str, np.ndarray]:
    """Of each leak the draws as they spread about their middles: columns place, depth, breadth, lean, spread, edge, side, gain, feather, tint."""
    u = draws(seed, LEAK_SALT, min(n, MAX_LEAKS), 10)
    # Least and most of what varies.
    lo, hi = np.array([[0.03, 0.30], [-1.7, 1.7], [-0.55, 0.75], [0.25, 1], [0.45, 1.35], [-0.2, 0.2]]).T
    varied = (lo + hi) / 2 + variation * (u[:, [2, 3, 4, 5, 7, 9]] - 0.5) * (hi - lo)
    out = dict(zip(("breadth", "lean", "spread", "edge", "gain", "tint"), varied.T, strict=True))
    place = (generator(seed, 4409, 0).random() + GOLDEN * np.arange(len(u)) + 0.10 * (u[:, 0] - 0.5)) % 1
    return out | {"place": place, "depth": u[:, 1], "side": np.where(u[:, 6] >= 0.5, 1, -1), "feather": u[:, 8]}


def _border(share: float, h: int, w: int) -> tuple[int, float, float]:
    """Which border (top, right, bottom, left, one after the other) a share of the frame's outline lies on, the border's length, and how far along (0 to 1), drawn away from the corners."""
    lengths = (w, h, w, h)
    ends = np.cumsum(lengths)
    which = min(int(np.searchsorted(ends, share * 2 * (h + w), side="right")), 3)
    t = float(np.clip((share * 2 * (h + w) - (ends[which] - lengths[which])) / lengths[which], 0, 1))
    return which, lengths[which], float(np.clip(t - 0.10 * math.sin(TURN * t), 0, 1))


def leaks(x: np.ndarray, p: dict, at) -> np.ndarray:
    n = int(p["light_leak"])
    if n < 1 or not at.frame_h:
        return x
    h, w, fh, fw, seed = *x.shape[-2:], at.frame_h, at.frame_w, int(p["texture_seed"])
    lo, hi = sorted((p["leak_size_min"] * at.scale, p["leak_size_max"] * at.scale))
    feather = p["leak_feather"] * at.scale
    blunt = 0.12 + 0.75 * min(1.0, feather / max(0.5 * (lo + hi), 1.0))
    rows, cols = (np.arange(h, dtype=np.float64) + at.y0)[:, None], (np.arange(w, dtype=np.float64) + at.x0)[None, :]
    c = leak_columns(seed, n, p["leak_variation"])
    reaches = np.minimum(lo + (hi - lo) * c["depth"], 0.5 * min(fh, fw) / 1.25)
    tints = np.clip(p["leak_hue"] + c["tint"], 0, 1)
    colours = np.stack([np.ones(len(tints)), 0.16 + 0.46 * tints, 0.04 + 0.18 * tints], axis=1)
    light = np.zeros((3, h, w))
    for k, reach in enumerate(reaches.tolist()):
        which, length, t = _border(float(c["place"][k]), fh, fw)
        inward, along = ((rows, cols), (fw - cols, rows), (fh - rows, cols), (cols, rows))[which]
        half = max(length * c["breadth"][k], 0.55 * reach)
        coarse = value_noise(at.y0, at.x0, h, w, max(16, 0.8 * reach), seed + 9137 + 37 * k, 3)
        fine = value_noise(at.y0, at.x0, h, w, max(6, 0.25 * reach), seed + 9701 + 37 * k, 2)
        wander = 1.5 * (coarse[:2] - 0.5) + 0.5 * (fine - 0.5)
        depth = np.maximum(0, inward + 0.15 * reach * wander[0])
        aside = (along - t * length) - c["lean"][k] * depth + 0.18 * half * wander[1]
        soft = min(max(feather * (1 + 0.45 * p["leak_variation"] * (2 * c["feather"][k] - 1)), 0.5), 0.95 * reach)
        fall = (1 - np.clip(depth / reach, 0, 1)) ** (math.log(0.5) / math.log(1 - min(soft / reach, 0.95)))
        blur_at = np.where(aside * c["side"][k] >= 0, max(0.03, blunt * (1 - 0.95 * c["edge"][k])), blunt)
        ramp = np.clip((1 + blur_at - np.abs(aside) / np.maximum(1, half * (0.75 + c["spread"][k] * depth / reach))) / (2 * blur_at), 0, 1)
        light += (fall * ramp * ramp * (3 - 2 * ramp) * (0.72 + 0.56 * coarse[2]) * c["gain"][k]) * colours[k][:, None, None]
    return display(linear(x) + (1 - np.exp(-2 * p["leak_strength"] * light)).astype(f32))


def scratch_softness(p: dict, s: float) -> float:
    """The widest blur of scratches; halo and kernel both come from here."""
    return 3 * p["scratch_soften"] * max(max(0.4, p["scratch_width"] * s), 0.6) if p["scratches"] >= 1 else 0.0


def scratches(x: np.ndarray, p: dict, at) -> np.ndarray:
    if p["scratches"] < 1 or not at.frame_h:
        return x
    h, w, s, seed = *x.shape[-2:], at.scale, int(p["texture_seed"])
    lay = (at.y0, at.x0, h, w)
    width = max(0.4, p["scratch_width"] * s)
    cell_x, cell_y = 2 * width, max(60, 900 * s)
    patches = max(at.frame_h * at.frame_w / (cell_x * cell_y), 1) * 26
    ta, tb = threshold(2.5 * p["scratches"] / patches), threshold(0.5 * p["scratches"] / patches)
    n = value_noise(*lay, cell_x, seed + 4409, 1, cell_y)[0]
    mark = ss(ta, max(tb, ta + 1e-4), n) * ss(0.30, 0.72, value_noise(*lay, max(24, 300 * s), seed + 4410, 1, max(8, 90 * s))[0])
    vary = ss(0.38, 0.78, value_noise(*lay, 6 * width, seed + 4411, 2, max(90, 1300 * s)))
    if (sigma := scratch_softness(p, s)) > 0:
        b = clamp(p["scratch_soften"] * ss(0.15, 0.85, vary[0]))
        mark = mark + (blur(mark, sigma) - mark) * b
    return x + f32(0.85) * mark * (0.25 + 0.75 * vary[1])


def fibres(p: dict, s: float) -> dict[str, np.ndarray]:
    """Columns of all hairs, lengths in pixels: place, half (length), thick (half width), edge, angle, bend, swing (two waves), turns, phase, alpha, level, reach."""
    u = draws(int(p["texture_seed"]), HAIR_SALT, min(int(p["hair"]), MAX_HAIR), 15)
    turns = np.array([0.6, 1.7]) + u[:, 7:9] * [0.9, 1.6]
    # A wave is no higher than its first limit, nor steeper than the second.
    swing = np.minimum([0.18, 0.07], np.array([0.55, 0.30]) / (TURN * turns)) * (2 * u[:, 5:7] - 1)
    half = np.maximum(0.5 * max(p["hair_length"], 1) * s * (0.65 + 0.75 * u[:, 2]), 1)
    thick = np.maximum(0.5 * max(1.6 * s, 0.35) * (0.7 + 0.8 * u[:, 11]), 0.02)
    soft = np.minimum(p["hair_soften"] * (0.25 + 1.5 * u[:, 14]), 1)
    edge = np.maximum(np.minimum(0.35 + 2.2 * soft, 0.9), 0.5 / thick)
    bend = 0.45 * (2 * u[:, 4] - 1)
    return {
        "place": scattered(u, int(p["texture_seed"]), HAIR_SALT), "half": half, "thick": thick, "edge": edge, "angle": TURN * u[:, 3], "bend": bend, "swing": swing, "turns": turns, "phase": TURN * u[:, 9:11],
        "alpha": (0.45 + 0.55 * u[:, 12]) * (1 - 0.45 * soft), "level": 0.02 + 0.28 * u[:, 13], "reach": half * (1 + np.abs(bend) + np.abs(swing).sum(axis=1)) + thick * (1 + edge) + 2,
    }


def hair(x: np.ndarray, p: dict, at) -> np.ndarray:
    if p["hair"] < 1 or not at.frame_h:
        return x
    x, c = x.copy(), fibres(p, at.scale)
    for k, part, dy, dx in within(x.shape[-2:], at, c["place"] * [at.frame_h, at.frame_w], c["reach"]):
        t, across = rotated(dy, dx, c["angle"][k])
        t, half, thick, edge = t / c["half"][k], c["half"][k], c["thick"][k], c["edge"][k]
        angle = TURN * c["turns"][k] * t[..., None] + c["phase"][k]
        curve = half * (c["bend"][k] * t * t + np.sin(angle) @ c["swing"][k])
        slope = 2 * c["bend"][k] * t + np.cos(angle) @ (TURN * c["swing"][k] * c["turns"][k])
        body = thick * (0.15 + 0.85 * (1 - ss(0.55, 1, np.abs(t))))
        near = np.abs(across - curve) / np.sqrt(1 + slope * slope) / np.maximum(body, 1)
        paint(x, part, c["level"][k], (1 - ss(1 - edge, 1 + edge, near)) * np.clip(body, 0, 1) * (1 - ss(0.92, 1, np.abs(t))) * c["alpha"][k])
    return x


def specks(p: dict, s: float) -> dict[str, np.ndarray]:
    """Columns of all specks, lengths in pixels: place, axes (half axes), angle, lobes (amplitudes of three), phase, edge, reach, level, alpha, light."""
    n = min(int(p["dust"]), MAX_DUST)
    u = draws(int(p["texture_seed"]), DUST_SALT, n, 12)
    light = np.arange(n) < round(int(p["dust"]) * (p["dust_balance"] + 1) / 2)
    radius = np.maximum(0.5 * max(p["dust_size"], 0.1) * s * (0.55 + u[:, 2] ** 2), 0.2)
    axes = radius[:, None] * (1 + u[:, [3]] * (0.10 + 0.45 * p["dust_irregular"]) * [1, -1])
    lobes = p["dust_irregular"] * (0.45 + 1.05 * u[:, [11]]) * [0.24, 0.17, 0.12]
    soft = np.minimum(p["dust_soften"] * (0.25 + 1.5 * u[:, 8]), max(p["dust_soften"], 1))
    edge = np.maximum(0.10 + 0.75 * soft, np.minimum(0.5 / axes[:, 1], 0.9))
    fade = 1 - p["dust_opacity_var"] * ((1 - u[:, 9]) + 0.45 * np.minimum(soft, 1) * u[:, 9])
    level = np.where(light, 1 - 0.28 * (1 - u[:, 10]) * p["dust_lum_var"], 0.42 * u[:, 10] * p["dust_lum_var"])
    return {
        "place": scattered(u, int(p["texture_seed"]), DUST_SALT), "axes": axes, "angle": TURN * u[:, 4], "lobes": lobes, "phase": TURN * u[:, 5:8], "edge": edge, "light": light,
        "reach": axes[:, 0] * (1 + lobes.sum(axis=1)) * (1 + edge) + 1, "level": np.clip(level, 0, 1), "alpha": np.clip(p["dust_opacity"] * fade * np.minimum(1, axes.prod(axis=1) / 0.25), 0, 1),
    }


def dust(x: np.ndarray, p: dict, at) -> np.ndarray:
    if p["dust"] < 1 or not at.frame_h:
        return x
    x, c = x.copy(), specks(p, at.scale)
    for k, part, dy, dx in within(x.shape[-2:], at, c["place"] * [at.frame_h, at.frame_w], c["reach"]):
        u, v = (q / r for q, r in zip(rotated(dy, dx, c["angle"][k]), c["axes"][k], strict=True))
        outline = 1 + np.cos(np.arctan2(v, u)[..., None] * [3, 4, 5] + c["phase"][k]) @ c["lobes"][k]
        paint(x, part, c["level"][k], (1 - ss(1 - c["edge"][k], 1 + c["edge"][k], np.hypot(u, v) / outline)) * c["alpha"][k])
    return x


def film_texture(x: np.ndarray, p: dict, at) -> np.ndarray:
    return dust(hair(scratches(leaks(x, p, at), p, at), p, at), p, at)
