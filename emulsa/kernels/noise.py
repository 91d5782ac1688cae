"""Noise as a function of absolute coordinates: any tile of a frame, anywhere, makes the same values."""

from __future__ import annotations

import math

import numpy as np

from .primitives import blur, f32, ss

# A 64-bit mixer's multipliers, and the fields' seeds and fits.
MX, MY, MS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FIELD, OCTAVE = 7919, 1301
FILL, SLOTS = 0.62, 3
GAIN, GAIN_FIT, CLUSTER_REF, CLUSTER_VAR = 0.29, (-0.04938, -0.02158, 0.16008, 0.48341), 0.6, 0.196
SMOOTH_FIT = (-8.9785, 4.6986, 17.5924)


def lattice(iy0: int, ix0: int, h: int, w: int, seed: int, fields: int) -> np.ndarray:
    """fields planes of values in [0, 1) at the integer points from (iy0, ix0)."""
    y = np.arange(iy0, iy0 + h, dtype=np.int64).astype(np.uint64) * np.uint64(MY)
    x = np.arange(ix0, ix0 + w, dtype=np.int64).astype(np.uint64) * np.uint64(MX)
    at = x[None, :] + y[:, None]
    out = np.empty((fields, h, w), f32)
    for f in range(fields):
        n = at + np.uint64((seed + FIELD * f) * MS % (1 << 64))
        n ^= n >> np.uint64(29)
        n *= np.uint64(M1)
        n ^= n >> np.uint64(32)
        n *= np.uint64(M2)
        n ^= n >> np.uint64(31)
        out[f] = (n >> np.uint64(40)).astype(np.float64) / (1 << 24)
    return out


def _axis(origin: int, n: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    at = (np.arange(n, dtype=np.float64) + origin) / cell
    base = np.floor(at)
    return base.astype(np.int64), (at - base).astype(f32)


def value_noise(y0: int, x0: int, h: int, w: int, cell: float, seed: int, fields: int = 1, cell_y: float | None = None) -> np.ndarray:
    iy, fy = _axis(y0, h, cell_y or cell)
    ix, fx = _axis(x0, w, cell)
    quintic = lambda f: f * f * f * (f * (6 * f - 15) + 10)
    fy, fx = quintic(fy)[:, None], quintic(fx)[None, :]
    lat = lattice(int(iy[0]), int(ix[0]), int(iy[-1] - iy[0]) + 2, int(ix[-1] - ix[0]) + 2, seed, fields)
    ky, kx = iy - iy[0], ix - ix[0]
    rows = lat[:, :, kx] * (1 - fx) + lat[:, :, kx + 1] * fx  # along x once for each row of the lattice
    return rows[:, ky] * (1 - fy) + rows[:, ky + 1] * fy


def cell_noise(y0: int, x0: int, h: int, w: int, cell: float, seed: int, fields: int = 1) -> np.ndarray:
    iy, _ = _axis(y0, h, cell)
    ix, _ = _axis(x0, w, cell)
    lat = lattice(int(iy[0]), int(ix[0]), int(iy[-1] - iy[0]) + 1, int(ix[-1] - ix[0]) + 1, seed, fields)
    return lat[:, (iy - iy[0])[:, None], (ix - ix[0])[None, :]]


def _octaves(layers: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """A weighted mean of fields about 0.5 that keeps one field's variance."""
    total, square = sum(w for _, w in layers), sum(w * w for _, w in layers)
    return f32(0.5) + (sum(n * f32(w) for n, w in layers) / f32(total) - f32(0.5)) * f32(total / math.sqrt(square))


def fbm(y0: int, x0: int, h: int, w: int, cell: float, seed: int, fields: int, octaves: int, rough: float) -> np.ndarray:
    base = max(0.8, cell)
    return _octaves([(value_noise(y0, x0, h, w, base * 2.0**o, seed + OCTAVE * o, fields), rough**o if o else 1.0) for o in range(max(1, octaves)) if o == 0 or rough > 0])


def smoothed(n: np.ndarray, amount: float, lo: float, hi: float) -> np.ndarray:
    """n blurred, with its strength put back by a fit."""
    if amount <= 0.001:
        return n
    sigma, r = amount * 0.5 * hi, lo / hi
    a, b, c = SMOOTH_FIT
    gain = math.sqrt(1 + ((a * r + b) * r + c) * (sigma / hi) ** 2)
    return f32(0.5) + (blur(n, sigma) - f32(0.5)) * f32(gain)


def grain_gain(lo: float, hi: float, depth: float) -> float:
    r = min(max(lo / hi, 0.0), 1.0)
    a, b, c, d = GAIN_FIT
    return GAIN / (((a * r + b) * r + c) * r + d) * math.sqrt((1 + CLUSTER_VAR * CLUSTER_REF**2) / (1 + CLUSTER_VAR * depth * depth))


def cluster(iy0: int, ix0: int, h: int, w: int, seed: int, depth: float) -> np.ndarray:
    """Brightness of cells: three octaves over cell indices."""
    layers = [(value_noise(iy0, ix0, h, w, 6.0 * 2**o, seed + OCTAVE * o)[0], 0.7**o) for o in range(3)]
    return 1 + f32(depth) * (_octaves(layers) * 2 - 1)


def grain_points(y0: int, x0: int, h: int, w: int, lo: float, hi: float, seed: int, fields: int, depth: float) -> np.ndarray:
    """Overlapping round grains on a turned lattice of cells as wide as the largest grain; where they overlap, they share by the cube of their shapes."""
    cell = hi
    angle = math.atan(1 / ((1 + math.sqrt(5)) / 2))
    c, s = math.cos(angle) / cell, math.sin(angle) / cell
    yy, xx = (np.arange(h, dtype=np.float64) + y0)[:, None], (np.arange(w, dtype=np.float64) + x0)[None, :]
    v, u = yy * c + xx * s, xx * c - yy * s
    iy, ix = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
    iy0, ix0 = int(iy.min()) - 1, int(ix.min()) - 1
    hl, wl = int(iy.max()) - iy0 + 2, int(ix.max()) - ix0 + 2
    per = 3 + fields
    lat = lattice(iy0, ix0, hl, wl, seed, SLOTS * per)
    bright = cluster(iy0, ix0, hl, wl, seed + 991, depth) if depth > 0.001 else f32(1)
    at = (iy - iy0) * wl + (ix - ix0)  # the cell of each pixel, in cells laid end to end
    fv, fu = (v - iy0).astype(f32), (u - ix0).astype(f32)
    peak, num, den = np.zeros((h, w), f32), np.zeros((fields, h, w), f32), np.zeros((h, w), f32)
    cy, cx = np.arange(hl, dtype=f32)[:, None], np.arange(wl, dtype=f32)[None, :]
    for slot in range(SLOTS):
        a = lat[slot * per : (slot + 1) * per]
        radius = np.where(a[2] < FILL, (lo + (hi - lo) * a[2] / FILL) / cell, 0).astype(f32)
        inverse = (1 / np.maximum(radius, f32(1e-12))).ravel()
        sign = (np.where(a[3:] < 0.5, f32(-1), f32(1)) * bright).astype(f32).reshape(fields, -1)
        py, px = (cy + a[0]).ravel(), (cx + a[1]).ravel()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                k = at + (dy * wl + dx)
                d, e = fv - py.take(k), fu - px.take(k)
                d *= d
                e *= e
                d += e
                np.sqrt(d, out=d)
                d += f32(1e-7)
                d *= inverse.take(k)
                np.minimum(d, f32(1), out=d)
                shape = 1 - d * d * (3 - 2 * d)
                np.maximum(peak, shape, out=peak)
                weight = shape * shape * shape
                den += weight
                for f in range(fields):
                    num[f] += weight * sign[f].take(k)
    return f32(0.5) + f32(0.5 * grain_gain(lo, hi, depth)) * peak * (num / np.maximum(den, f32(1e-12)))
